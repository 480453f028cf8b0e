"""Tests of the training-data subpackage (a package, so that its conftest keeps a name of its own)."""
