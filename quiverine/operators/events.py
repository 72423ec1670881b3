"""What training and queries report as they go, to a callback on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Event:
    """A step's name and what is known about it."""

    name: str
    detail: dict[str, Any] = field(default_factory=dict)


Listener = Callable[[Event], None]

CLUSTER_EVENTS = ("start_init", "finish_init", "start_update", "finish_update", "start_reassign", "finish_reassign")
#: ``start_quantize`` to ``finish_quantize`` name their division; ``cluster`` holds an event of k-means.
BUILD_EVENTS = ("start_ids", "finish_ids", "start_partition", "cluster", "finish_partition", "start_divide", "finish_divide", "start_quantize", "finish_quantize")
QUERY_EVENTS = ("start_query_init", "finish_query_init", "start_probe", "finish_probe", "start_partition_query", "finish_partition_query", "start_select", "finish_select")
ASYNC_QUERY_EVENTS = (
    "start_load_centroids", "finish_load_centroids", "start_load_codebooks", "finish_load_codebooks", "start_probe", "finish_probe",
    "start_load_partition", "finish_load_partition", "start_partition_query", "finish_partition_query", "start_select", "finish_select",
)


def tell(listener: Listener | None, name: str, **detail: Any) -> None:
    if listener is not None:
        listener(Event(name, detail))
