"""Relational operators over palettes, tiles, screens, frames and textures."""
