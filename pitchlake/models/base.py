"""What all state models offer, and their storage as JSON documents that name their kind."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from pitchlake.errors import ModelError
from pitchlake.sources.store import read_text, write_text


class StateModel(Protocol):
    """States over named columns of a DataFrame; labels and probabilities come as columns beside the keys."""

    columns: list[str]

    @property
    def n_states(self) -> int: ...

    def to_json(self) -> str: ...

    @classmethod
    def from_json(cls, text: str) -> StateModel: ...


def save_model(spark: SparkSession, model: StateModel, path: str) -> None:
    write_text(spark, path, model.to_json())


def load_model[M: StateModel](spark: SparkSession, kind: type[M], path: str) -> M:
    """ModelError if the document is no model of that kind, SourceError if there is none."""
    text = read_text(spark, path)
    try:
        return kind.from_json(text)
    except (ValueError, KeyError, TypeError) as e:
        raise ModelError(f"{path} is no {kind.__name__}") from e


def labelled(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df that have an answer, with the answer's columns."""
    return df.join(found, keys)
