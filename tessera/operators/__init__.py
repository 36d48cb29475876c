"""DataFrame operators: synchronising, clouds, grids, descriptors, odometry, estimation, vision, rasters."""
