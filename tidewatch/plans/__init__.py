"""The gold models and the order they are built in."""
