"""Tests of the training-data operators; a package, so that its fixtures stay apart from those of the library."""
