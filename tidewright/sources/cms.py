"""Webhook payloads of content systems as common rows, and their signatures."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewright.operators.changefeed import change_kind

#: Where each platform keeps its fields: JSON paths, the first that is neither null nor empty counts.
FIELDS = {
    "contentful": {"content_id": ["$.sys.id"], "content_type": ["$.sys.contentType.sys.id", "$.sys.type"], "event": ["$.topic"], "slug": ["$.fields.slug.en-US"],
                   "title": ["$.fields.title.en-US", "$.fields.name.en-US"], "content": ["$.fields.body.en-US", "$.fields.content.en-US"], "last_modified": ["$.sys.updatedAt", "$.sys.createdAt"]},
    "sanity": {"content_id": ["$._id", "$.documentId"], "content_type": ["$._type"], "event": ["$.operation"], "slug": ["$.slug.current"], "title": ["$.title"], "content": ["$.body", "$.content"], "last_modified": ["$._updatedAt"]},
    "strapi": {"content_id": ["$.entry.id", "$.model"], "content_type": ["$.model"], "event": ["$.event"], "slug": ["$.entry.slug"], "title": ["$.entry.title", "$.entry.name"], "content": ["$.entry.content", "$.entry.body"],
               "last_modified": ["$.entry.updatedAt", "$.entry.updated_at"]},
    "wordpress": {"content_id": ["$.post.ID", "$.post.id", "$.ID", "$.id"], "content_type": ["$.post.post_type", "$.post_type"], "event": ["$.action"], "slug": ["$.post.post_name", "$.post_name"],
                  "title": ["$.post.post_title", "$.post_title"], "content": ["$.post.post_content", "$.post_content"], "last_modified": ["$.post.post_modified", "$.post.post_date", "$.post_modified", "$.post_date"]},
}
DEFAULT_TYPE = {"contentful": "unknown", "sanity": "document", "strapi": "entry", "wordpress": "post"}


def normalized(payloads: DataFrame) -> DataFrame:
    """platform, content_id, content_type, event, path, title, content, last_modified of raw payloads. payloads: platform, payload (JSON).

    Fields fall back in order; an unknown event is an update; a payload that is no JSON has only defaults. Platforms without a mapping are dropped.
    """
    def field(name: str) -> Column:
        out = F.lit(None).cast("string")
        for platform, fields in FIELDS.items():
            first = F.coalesce(*[F.nullif(F.get_json_object("payload", p), F.lit("")) for p in fields[name]])
            out = F.when(F.col("platform") == platform, first).otherwise(out)
        return out

    default = F.create_map(*[F.lit(x) for kv in DEFAULT_TYPE.items() for x in kv])
    slug = field("slug")
    return payloads.where(F.col("platform").isin(list(FIELDS))).select(
        "platform", F.coalesce(field("content_id"), F.lit("")).alias("content_id"), F.coalesce(field("content_type"), F.element_at(default, F.col("platform"))).alias("content_type"),
        F.concat(F.lit("content."), change_kind(field("event"))).alias("event"), F.concat(F.lit("/"), slug).alias("path"), F.coalesce(field("title"), F.lit("")).alias("title"),
        F.coalesce(field("content"), F.lit("")).alias("content"), F.try_to_timestamp(field("last_modified")).alias("last_modified"))


def _text_of(node) -> list[str]:
    if isinstance(node, dict):
        own = [node["value"]] if isinstance(node.get("value"), str) and node.get("value") else []
        return own + [t for c in node.get("content") or [] for t in _text_of(c)] if isinstance(node.get("content"), list) or own else own
    if isinstance(node, list):
        return [t for c in node for t in _text_of(c)]
    return []


def rich_text(c: Column) -> Column:
    """The texts of a rich-text tree in order, joined by spaces; null where it is no JSON."""

    def each(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            try:
                out.append(" ".join(_text_of(json.loads(x))) if isinstance(x, str) else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(each, "string")(c)


def signature_valid(platform: Column, body: Column, signature: Column, secret: str) -> Column:
    """Whether the HMAC-SHA256 of the body fits: base64 for contentful, hex for sanity, strapi and wordpress, either or the secret itself for custom."""

    def each(p: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for kind, text, given in zip(p, b, s):
            if given is None or text is None:
                out.append(False)
                continue
            mac = hmac.new(secret.encode(), text.encode(), hashlib.sha256).digest()
            code, hexed = base64.b64encode(mac).decode(), mac.hex()
            valid = {"contentful": [code], "custom": [hexed, code, secret]}.get(kind, [hexed])
            out.append(any(hmac.compare_digest(v.encode(), given.encode()) for v in valid))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(each, "boolean")(platform, body, signature)
