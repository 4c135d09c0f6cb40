"""Time loops: output policies and steps over batches of time."""
