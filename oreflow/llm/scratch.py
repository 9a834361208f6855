"""Intermediate tables in the shared folder, as the operators of this subpackage use them."""

from oreflow.functions.storage import dropped, kept, new_path, shared_folder

__all__ = ["dropped", "kept", "new_path", "shared_folder"]
