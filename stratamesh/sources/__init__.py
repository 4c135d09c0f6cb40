"""Reading and writing meshes, configurations and analytic fields."""
