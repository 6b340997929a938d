"""A Spark-native data layer: tables, model outputs, listeners and vector search as DataFrames."""

from quillon.database import Database, VectorIndex, connect
from quillon.operators.models import Metric, Model, Sequential
from quillon.plans.predicates import Field, Predicate
from quillon.plans.query import Query
from quillon.streaming.listener import Listener

__all__ = ["Database", "Field", "Listener", "Metric", "Model", "Predicate", "Query", "Sequential", "VectorIndex", "connect"]
