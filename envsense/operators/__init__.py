"""Operators on DataFrames: filters, detectors, fusion, calibration, catalogue, features, audio."""
