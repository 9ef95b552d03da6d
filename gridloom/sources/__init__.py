"""Sources, sinks and the registry of sources."""
