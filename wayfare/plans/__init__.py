"""Named results: each function takes a Warehouse and returns one small table."""
