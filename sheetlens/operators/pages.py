"""Pages of documents, their text, and the pluggable model that inspects them.

These three steps call outside code, so they are the only ones that run Python; what each returns is to be written before the next
step, so that a retry does not call a model again. Each keeps its errors to the row that they belong to: one file, one page.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import MAX_PAGES, MAX_REPLY_TOKENS, OCR_PREFIX

#: Splits one file into page images; the default sees form feeds, a real one calls a PDF library.
Splitter = Callable[[bytes, int], list[bytes]]


def form_feed_pages(content: bytes, limit: int) -> list[bytes]:
    return content.split(b"\f")[:limit]


class Reader(Protocol):
    def __call__(self, image: bytes) -> str: ...


class Inspector(Protocol):
    """Answers one page's prompt with the text of a JSON reply of at most ``max_tokens`` tokens. ``image`` is what ``Encoder`` made."""

    def __call__(self, prompt: str, image: bytes, max_tokens: int) -> str: ...


#: A page image as the model takes it: a real one makes a JPEG and its base64 text, the default only the latter.
Encoder = Callable[[bytes], bytes]


def error_text(e: Exception) -> str:
    """An exception as a reviewer reads it: its class and what it says."""
    return f"{type(e).__name__}: {e}"


def page_function(splitter: Splitter, limit: int):
    """``splitter`` as a table function of a file's content: (page_number from 1, total_pages, image, null), or one row with the error that it raised, or one of nulls if there are no pages."""

    class Pages:
        def eval(self, content: bytes | None):
            try:
                if content is None:
                    raise FileNotFoundError("the file is gone")
                pages = list(splitter(bytes(content), limit))
            except Exception as e:  # whatever a PDF library raises: this document fails, the others go on
                yield None, None, None, error_text(e)
                return
            for n, page in enumerate(pages, 1):
                yield n, len(pages), page, None
            if not pages:
                yield None, None, None, None

    return F.udtf(Pages, returnType="page_number int, total_pages int, image binary, error string", useArrow=False)


def split_pages(files: DataFrame, splitter: Splitter = form_feed_pages, limit: int = MAX_PAGES) -> DataFrame:
    """(document_id, page_number from 1, total_pages, image, error) of the first ``limit`` pages of ``files(document_id, content)``.

    A file that cannot be split has one row with its error and no page; one without pages has one row without either.
    """
    pages = page_function(splitter, limit)(F.col("content").outer())
    return files.select("document_id", "content").lateralJoin(pages).select("document_id", "page_number", "total_pages", "image", "error")


def read_text(pages: DataFrame, reader: Reader) -> DataFrame:
    """Pages with ``ocr_text``; a page that cannot be read has an empty text."""

    def one(image: bytes) -> str:
        try:
            return reader(bytes(image)).strip()
        except Exception:  # whatever an OCR engine raises
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ocr_text=[one(x) for x in b["image"]])

    return pages.mapInPandas(run, "document_id string, page_number int, total_pages int, image binary, ocr_text string")


def with_prompt(pages: DataFrame) -> DataFrame:
    """Pages with the prompt. Their document's ``total_pages`` were counted when it was split, so no page moves."""
    return pages.withColumn("prompt", X.prompt(F.col("page_number"), F.col("total_pages"), F.col("ocr_text")))


def inspect(pages: DataFrame, inspector: Inspector, max_tokens: int = MAX_REPLY_TOKENS, encoder: Encoder = b64encode) -> DataFrame:
    """``pages(key, prompt, image)`` to (key, raw, error): the model's reply, or what it raised.

    Pages are asked side by side, also those after a page that fails; what they find is left out later.
    """

    def one(prompt: str, image: bytes) -> tuple[str | None, str | None]:
        try:
            return inspector(prompt, encoder(bytes(image)), max_tokens), None
        except Exception as e:  # the document fails, the job goes on
            return None, error_text(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(p, i) for p, i in zip(b["prompt"], b["image"], strict=True)]
            yield b[["key"]].assign(raw=[r for r, _ in got], error=[e for _, e in got])

    return pages.select("key", "prompt", "image").mapInPandas(run, "key string, raw string, error string")


def asked_key(prompt: Column, image: Column) -> Column:
    """What a question to the model is known by: all that it is told."""
    return F.sha2(F.concat_ws("|", F.sha2(prompt, 256), F.sha2(image, 256)), 256)


def stored_text(col: str = "ocr_text"):
    """The part of a page's text that is stored with its issues; null if there is none."""
    return X.empty_to_null(F.substring(col, 1, OCR_PREFIX))
