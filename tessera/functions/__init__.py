"""Part of Tessera; see the README."""
