"""Sources and sinks: catalogs, texts, secrets, configuration."""
