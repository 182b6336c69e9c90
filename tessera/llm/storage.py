"""Scratch tables of this subpackage: the library's own."""

from tessera.storage import discard, materialize, scratch_path, shared_dir

__all__ = ["discard", "materialize", "scratch_path", "shared_dir"]
