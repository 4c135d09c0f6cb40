from pyspark.sql import functions as F

from stratamesh.functions import keys as K


def L(x):
    return F.lit(x).cast("long")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_known_codes(spark):
    row = one(spark, a=K.encode([L(5), L(6)], [L(7777), L(3333)], L(8), L(1)), b=K.encode([L(2), L(3), L(4)], [L(2048), L(16383), L(4096)], L(5), L(2)))
    assert (row.a, row.b) == (256705187183600417, 158949013592361258)


def test_round_trip_and_family(spark):
    key = K.encode([L(5), L(6)], [L(4096), L(8192)], L(12), L(0))
    row = one(spark, x=K.octant_coords(key)[0], y=K.octant_coords(key)[1], t=K.tree_coords(key)[1], level=K.level(key), up=K.father(K.child(key, 3)) == key, c=K.child_id(K.child(key, 2)), top=K.father(K.encode([L(0), L(0)], [L(0), L(0)], L(0))))
    assert (row.x, row.y, row.t, row.level, row.up, row.c, row.top) == (4096, 8192, 6, 12, True, 2, None)


def test_child_tables():
    assert [K.touching_child([f]) for f in range(4)] == [1, 0, 2, 0]
    assert [K.touching_child([f]) for f in range(6)] == [1, 0, 2, 0, 4, 0]
    assert [K.touching_child([a, b]) for b in (2, 3) for a in (0, 1)] == [3, 2, 1, 0]


def test_neighbor_against_plain_arithmetic(spark):
    brick, cases = (3, 2), []
    for level in (0, 1, 3):
        n, size = 1 << level, 1 << (22 - level)
        for tx, ty, x, y in ((0, 0, 0, 0), (2, 1, n - 1, n - 1), (1, 0, n // 2, 0)):
            cases += [(level, tx, ty, x * size, y * size, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    df = spark.createDataFrame(cases, "level long, tx long, ty long, x long, y long, dx int, dy int")
    key = K.encode([F.col("tx"), F.col("ty")], [F.col("x"), F.col("y")], F.col("level"))
    pick = F.coalesce(*[F.when((F.col("dx") == a) & (F.col("dy") == b), K.neighbor(key, (a, b), brick, (True, False))) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    for r in df.withColumn("n", pick).select("*", *[c.alias(f"o{i}") for i, c in enumerate(K.octant_coords(F.col("n")) + K.tree_coords(F.col("n")))], K.outside_status(F.col("n")).alias("out")).collect():
        root, out = 1 << 22, 0
        gx, gy = r.tx * root + r.x + r.dx * (root >> r.level), r.ty * root + r.y + r.dy * (root >> r.level)
        if not 0 <= gy < 2 * root:
            out = 2
        gx, gy = gx % (3 * root), gy % (2 * root)
        assert (r.o0, r.o1, r.o2, r.o3, r.out) == (gx % root, gy % root, gx // root, gy // root, out)


def test_order_is_unsigned(spark):
    high = K.encode([L(0), L(63)], [L(0), L(0)], L(0))
    row = one(spark, ok=K.ordered(high) > K.ordered(K.encode([L(0), L(31)], [L(0), L(0)], L(0))), negative=high < 0)
    assert row.ok and row.negative
