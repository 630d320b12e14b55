"""Plans that join tiles, layers, sources and resources."""
