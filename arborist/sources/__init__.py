"""Sources of the engine's tables."""
