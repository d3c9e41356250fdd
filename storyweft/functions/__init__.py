"""Part of storyweft."""
