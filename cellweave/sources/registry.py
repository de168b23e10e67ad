"""Reader registry: an id names a reader and the inputs it declares; the choice is always explicit."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from . import text


@dataclass(frozen=True)
class Reader:
    reader_id: str
    read: Callable
    inputs: tuple[str, ...]


_READERS: dict[str, Reader] = {}


def register(reader_id: str, read: Callable | str, inputs: tuple[str, ...] = ()) -> Reader:
    """Add a reader given as a callable or as ``module:function``."""
    if reader_id in _READERS:
        raise ValueError(f"reader {reader_id} is already registered")
    if isinstance(read, str):
        module, _, function = read.partition(":")
        read = getattr(import_module(module), function)
    if not callable(read):
        raise ValueError("a reader must be callable")
    _READERS[reader_id] = Reader(reader_id, read, inputs)
    return _READERS[reader_id]


def get(reader_id: str) -> Reader:
    if reader_id not in _READERS:
        raise ValueError(f"unknown reader {reader_id}; available: {sorted(_READERS)}")
    return _READERS[reader_id]


def available() -> list[str]:
    return sorted(_READERS)


register("tenx_mtx", text.read_tenx, ("matrix", "features", "barcodes", "positions"))
register("xenium", text.read_xenium, ("cells_csv", "matrix", "features", "barcodes"))
register("visium", text.read_visium, ("positions", "matrix", "features", "barcodes"))
register("cosmx_csv", text.read_cosmx, ("metadata", "counts"))
register("merscope_csv", text.read_merscope, ("metadata", "counts"))
register("annotated_tables", text.read_annotated_tables, ("obs", "var", "triplets"))
register("linked_shapes", text.link_shapes, ("obs", "shapes"))
register("snapshot", text.read_snapshot, ("path",))
