"""Step graphs, and sampling of windows."""
