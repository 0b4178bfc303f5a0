"""No streaming operators: the engine is batch only, and its supersteps are bounded.

A frontier is a DataFrame rebound at every level, not a stream window.
"""
