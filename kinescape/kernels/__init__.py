"""Image kernels of one frame in numpy, from their published definitions."""
