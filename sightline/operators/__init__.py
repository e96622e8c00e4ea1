"""DataFrame -> DataFrame operators; configuration arrives as plain dictionaries."""
