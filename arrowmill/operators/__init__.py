"""The steps of a pipeline by name: (compiler, frame, argument nodes, environment) to a frame or value."""

from .aggregate import AGGREGATES
from .joins import JOINS
from .rows import ROWS
from .windows import WINDOWS

STEPS = {**ROWS, **AGGREGATES, **JOINS, **WINDOWS}
