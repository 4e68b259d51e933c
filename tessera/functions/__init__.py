"""Column functions: text, media metadata, configuration."""
