"""Kept empty on purpose: the operators reproduced here are batch operators without
windows over time, watermarks or state, so there is nothing to stream."""
