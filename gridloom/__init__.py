"""PySpark-native table analytics: declarative views, profiles, tiles, connectors."""
