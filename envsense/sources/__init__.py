"""Readers and writers: packets, event bundles, waveforms, calibration tables, and views of the test tables."""
