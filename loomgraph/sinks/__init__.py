"""Writers of the engine's outputs."""
