"""Declarative feature functions, their compiler and ready-made workloads."""
