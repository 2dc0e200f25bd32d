"""Sources over the network: addresses, a partition service, model servers. One request a row, an Arrow batch at a time;
a request that fails gives its reason in ``error`` and doesn't end the job."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from urllib import request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "doc_id bigint, url string, content binary, content_type string, error string"
ANSWERED = "doc_id bigint, response string, error string"


def fetch(urls: DataFrame, url_col: str = "url", headers: dict[str, str] | None = None, timeout: float = 60) -> DataFrame:
    """Content and content type of addresses; ``sources.filetype.detect(df, "content_type")`` goes on from there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, url in zip(pdf["doc_id"], pdf["url"]):
                try:
                    with request.urlopen(request.Request(url, headers=headers or {}), timeout=timeout) as r:
                        out.append((doc, url, r.read(), r.headers.get("Content-Type"), None))
                except Exception as e:  # noqa: BLE001
                    out.append((doc, url, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["doc_id", "url", "content", "content_type", "error"])

    return urls.select("doc_id", F.col(url_col).alias("url")).mapInPandas(run, FETCHED)


def post_json(rows: DataFrame, endpoint: str, payload_col: str = "payload", headers: dict[str, str] | None = None, timeout: float = 60) -> DataFrame:
    """The answers of a service to JSON texts: what the clients of layout, table, formula and recognition models do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, body in zip(pdf["doc_id"], pdf["payload"]):
                try:
                    req = request.Request(endpoint, data=(body or "").encode(), headers={"Content-Type": "application/json", **(headers or {})})
                    with request.urlopen(req, timeout=timeout) as r:
                        out.append((doc, r.read().decode(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((doc, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["doc_id", "response", "error"])

    return rows.select("doc_id", F.col(payload_col).cast("string").alias("payload")).mapInPandas(run, ANSWERED)


def image_payload(image: bytes, **params) -> str:
    """The request body of a model server for an image."""
    return json.dumps({"b64_image": base64.b64encode(image).decode(), **params})


def partition_via_api(files: DataFrame, endpoint: str, api_key: str = "", timeout: float = 60) -> DataFrame:
    """Elements that a partition service makes of files (doc_id, path, content)."""
    from ..functions.metadata import file_name
    from ..operators.staging import from_isd

    body = F.to_json(F.struct(file_name(F.col("path")).alias("filename"), F.base64("content").alias("b64_data"), F.lit("partition").alias("mode")))
    answers = post_json(files.select("doc_id", body.alias("payload")), endpoint, headers={"api-key": api_key} if api_key else None, timeout=timeout)
    lists = F.coalesce(F.get_json_object("response", "$.partitions"), F.col("response"))
    return from_isd(answers.filter("error is null").select("doc_id", lists.alias("isd")))


LANGUAGES = frozenset("ar cs da de el en es et fi fr he hi hu id it ja ko lt lv nl no pl pt ro ru sk sl sv th tr uk vi zh".split())


def translation_model(source: str, target: str = "en") -> str:
    """The name of the public model that translates between two languages; running it needs its weights."""
    for code in (source, target):
        if code not in LANGUAGES:
            raise ValueError(f"not a known language code: {code}")
    return f"Helsinki-NLP/opus-mt-{source}-{target}"


def translate(*_, **__):
    raise NotImplementedError("translation needs a model's weights, which aren't here")
