"""Operators on signals, events, spike trains and waveforms."""
