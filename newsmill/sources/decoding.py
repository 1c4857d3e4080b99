"""Bytes of a response to text: byte order mark, then the header's charset, then the document's, else UTF-8."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
_DECLARED = re.compile(rb"""<\?xml[^>]*encoding=["']([\w.:-]+)["']|<meta[^>]*charset=["']?([\w.:-]+)""", re.I)
#: Labels that browsers read as a larger page (fixed values).
_WIDER = {"iso-8859-1": "cp1252", "latin-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "gb2312": "gb18030", "iso-8859-9": "cp1254", "shift_jis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949"}


def _known(label: str | None) -> str | None:
    label = (label or "").strip().lower()
    try:
        return codecs.lookup(_WIDER.get(label, label)).name if label else None
    except LookupError:
        return None


def decode(body: bytes | None, content_type: str | None = None) -> tuple[str | None, str | None, str | None, bool]:
    """(text, charset, where the charset is from, whether bytes were lost) of a body; nulls for no body."""
    if body is None:
        return None, None, None, False
    mark = next(((m, c) for m, c in _MARKS if body.startswith(m)), None)
    header = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    found = _DECLARED.search(body[:4096])
    header_set, own = _known(header and header[1]), _known(found and (found[1] or found[2]).decode("ascii", "ignore"))
    if mark:
        charset, origin, body = mark[1], "bom", body[len(mark[0]) :]
    elif header_set:
        charset, origin = header_set, "http"
    elif own:
        charset, origin = own, "document"
    else:
        charset, origin = "utf-8", "default"
    text = body.decode(charset, "replace")
    if origin != "bom" and charset.startswith(("cp125", "iso8859")) and re.search("[ÃÅ][\x80-\xbf‘’€-™]", text):
        try:
            text, charset, origin = body.decode("utf-8"), "utf-8", "recovered"
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", text), charset, origin, "�" in text


def decoded(df: DataFrame, key: str, body: str, content_type: str) -> DataFrame:
    """(key, text, charset, origin, lossy) of binary bodies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *decode(x, t)) for k, x, t in zip(b[key], b[body], b[content_type])]
            yield pd.DataFrame(rows, columns=[key, "text", "charset", "origin", "lossy"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, body, content_type).mapInPandas(run, f"`{key}` {kind}, text string, charset string, origin string, lossy boolean")
