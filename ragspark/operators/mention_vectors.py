"""Embeddings of mentions (D7, G11): each distinct text is embedded once, whatever the number of its mentions, and kept up as mentions come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plug import Embedder, embed


def text_key(text: str = "mention_text") -> Column:
    """Mentions of one text, ignoring case and outer spaces, share a vector."""
    return F.lower(F.trim(F.col(text)))


def mention_vectors(mentions: DataFrame, embedder: Embedder, known: DataFrame | None = None) -> DataFrame:
    """mention_id, embedding, created_at of the mentions (mention_id, mention_text) that `known` lacks.

    Their distinct texts go through the embedder; a text that many mentions have is one row there,
    and the join back to its mentions is one that can be split. Null ids and texts, and blank texts,
    have no vector.
    """
    todo = mentions.filter("mention_id is not null").select("mention_id", text_key().alias("_key")).filter("_key <> ''").dropDuplicates(["mention_id"])
    if known is not None:
        todo = todo.join(known.select("mention_id"), "mention_id", "left_anti")
    texts = embed(todo.select("_key").distinct(), embedder, "_key")
    return todo.join(texts, "_key").select("mention_id", "embedding", F.current_timestamp().alias("created_at"))


def kept_up(known: DataFrame, mentions: DataFrame, embedder: Embedder) -> DataFrame:
    """The vectors of the mentions that there are: old ones stay as they are, new mentions get theirs, those of mentions that went go."""
    live = known.join(mentions.select("mention_id").distinct(), "mention_id", "left_semi")
    return live.unionByName(mention_vectors(mentions, embedder, known))
