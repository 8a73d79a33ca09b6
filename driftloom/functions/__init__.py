"""Shared functions: staging, dense ids, statistics and numeric kernels."""
