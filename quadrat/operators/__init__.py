"""Operators over tables of particles, observations, graphs, segments and voxels."""
