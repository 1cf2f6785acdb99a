"""The one Python stage of message loading: MIME bytes to the columns of ``messages``.

MIME decoding is a per-message codec that Spark lacks, so it runs in Arrow batches with the
standard library parser.  Everything that can be computed from its output is native.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.headerregistry import HeaderRegistry
from email.utils import getaddresses, parseaddr
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens import schemas

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}


#: Messages, and bytes of them, that a worker holds in parsed form at once.
SLICE_ROWS, SLICE_BYTES = 250, 1 << 22
#: Parsed headers that a task keeps, each of at most 1,000 characters.
REMEMBERED = 2000


class _Anchors(HTMLParser):
    """Collects web links with their visible text, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self._open: list[tuple[str, dict | None]] = []
        self._pending: list[str] = []

    def _flush(self) -> None:
        piece = "".join(self._pending).strip()
        self._pending.clear()
        if piece:
            for _, link in self._open:
                if link is not None:
                    link["parts"].append(piece)

    def handle_starttag(self, tag, attrs):
        self._flush()
        link = None
        if tag == "a":
            href = dict(attrs).get("href")
            if href and href.startswith(("http://", "https://")):
                link = {"url": href, "parts": []}
                self.found.append(link)
        if tag not in _VOID:
            self._open.append((tag, link))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if any(t == tag for t, _ in self._open):
            while self._open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not (self._open and self._open[-1][0] in ("script", "style")):
            self._pending.append(data)

    def links(self) -> list[dict]:
        self._flush()
        return [{"url": x["url"], "anchor_text": "".join(x["parts"]) or None}
                for x in self.found]


def _anchors(html: str) -> list[dict]:
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    return parser.links()


def header_rules() -> policy.EmailPolicy:
    """The default policy with headers read as its registry reads them, for the messages of one task.

    Free text without encoded words is its own reading; the grammar would cost a message milliseconds to say
    so.  Of structured headers (addresses, dates, content types), which repeat, the last ones are kept.
    """
    registry = HeaderRegistry()
    remembered = lru_cache(REMEMBERED)(lambda name, value: registry(name, value))

    def read(name: str, value: str):
        kind = name.lower()
        if (kind == "subject" or kind not in registry.registry) and value.isascii() and "=?" not in value:
            return value
        return remembered(name, value) if len(value) <= 1000 else registry(name, value)

    return policy.default.clone(header_factory=read)


class _Content(NamedTuple):
    """What one walk over the parts of a message gathers."""

    plain: str
    html: str
    trace: str
    files: list[dict]


def _decoded(payload: bytes, charset: str) -> str | None:
    try:
        return payload.decode(charset, "replace")
    except LookupError:  # a charset nobody knows
        return None


def _content(msg) -> _Content:
    """One walk: every part's headers are parsed once and its payload is decoded once."""
    single = not msg.is_multipart()
    aside = set() if single else {id(p) for p in msg.iter_attachments()}
    shown: dict[str, list[str]] = {"plain": [], "html": []}
    traced: list[str] = []
    files: list[dict] = []
    for part in msg.walk():
        header = part["content-type"]
        kind = part.get_default_type() if header is None else f"{header.maintype}/{header.subtype}".lower()
        params = {} if header is None else header.params
        placed = part["content-disposition"]
        text = kind in ("text/plain", "text/html")
        if not (text or id(part) in aside or single and kind.startswith("text/")):
            continue
        payload = part.get_payload(decode=True) or b""
        if single or text and (placed is None or placed.content_disposition != "attachment"):
            body = _decoded(payload, params.get("charset", "ascii"))
            shown["plain" if kind == "text/plain" else "html"].append(body or "")
        if text and payload and "attachment" not in str(placed or ""):
            traced.append(payload.decode(params.get("charset") or "utf-8", "replace"))
        if id(part) in aside:
            name = None if placed is None else placed.params.get("filename")
            name = params.get("name") if name is None else name
            files.append({
                "filename": None if name is None else name.strip(), "content_type": kind,
                "size": len(payload), "sha256": hashlib.sha256(payload).hexdigest() if payload else None})
    return _Content("".join(shown["plain"]), "".join(shown["html"]), "\n".join(traced), files)


def _pairs(headers: list[str]) -> list[dict]:
    return [{"name": n, "addr": a} for n, a in getaddresses(headers)]


def parse_message(content: bytes, rules: policy.EmailPolicy = policy.default) -> dict:
    """One message to the parsed columns; ``error`` is set instead when it cannot be parsed."""
    row = dict.fromkeys(PARSED)
    try:
        msg = message_from_bytes(bytes(content), policy=rules)
        headers = {h: [str(v) for v in msg.get_all(h, [])] for h in _HEADERS}
        first = {h: values[0] if values else None for h, values in headers.items()}
        found = _content(msg)
        name, addr = parseaddr(first["To"] or "")
        row.update(
            message_id=first["Message-ID"], subject=first["Subject"],
            from_raw=first["From"], to_raw=first["To"], date_raw=first["Date"],
            from_addr=_pairs(headers["From"]),
            to_addr=[{"name": name, "addr": addr}] if addr else [],
            reply_to=_pairs(headers["Reply-To"]),
            return_path_raw=first["Return-Path"], sender_raw=first["Sender"],
            auth_headers=headers["Authentication-Results"],
            received_spf=first["Received-SPF"], received=headers["Received"],
            x_headers={h: first[h] for h in fv.CLIENT_IP_HEADERS if first[h] is not None},
            body_plain=found.plain, body_html=found.html, trace_body=found.trace,
            anchors=_anchors(found.html) if found.html else [], attachments=found.files,
        )
    except Exception as e:
        row = dict.fromkeys(PARSED)
        row["error"] = f"{type(e).__name__}: {e}"
    return row


_HEADERS = ("Message-ID", "Subject", "From", "To", "Date", "Reply-To", "Return-Path", "Sender",
            "Authentication-Results", "Received-SPF", "Received", *fv.CLIENT_IP_HEADERS)
PARSED = [
    part.split()[0] for part in schemas.MESSAGES.replace("\n", " ").split(", ")
]
PARSED = [c for c in PARSED if c not in ("email_id", "path")]


def _clean(value):
    """Lone surrogates from undecodable header bytes cannot travel as UTF-8."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, list):
        return [_clean(v) for v in value]
    if isinstance(value, tuple):
        return tuple(_clean(v) for v in value)
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items()}
    return value


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parsed rows leave in slices: a message is held as bytes, text, object and Arrow column at once."""
    rules = header_rules()
    for batch in batches:
        at = 0
        while at < len(batch):
            sizes = batch["content"].iloc[at:at + SLICE_ROWS].map(lambda c: 0 if c is None else len(c)).cumsum()
            piece = batch.iloc[at:at + max(1, int((sizes <= SLICE_BYTES).sum()))]
            at += len(piece)
            rows = [{k: _clean(v) for k, v in parse_message(c, rules).items()} for c in piece["content"]]
            parsed = pd.DataFrame(rows, columns=PARSED, dtype=object)
            parsed.insert(0, "email_id", piece["email_id"].to_numpy())
            parsed.insert(1, "path", piece["path"].to_numpy())
            yield parsed
        # A worker lives on from task to task, and Arrow keeps what its largest batch took.
        pa.default_memory_pool().release_unused()


def parse_messages(raw: DataFrame) -> DataFrame:
    """``email_id, path, content`` to ``messages``.  The bytes go no further than this stage."""
    if "email_id" not in raw.columns:
        raw = raw.withColumn("email_id", F.sha2("content", 256))
    return raw.select("email_id", "path", "content").mapInPandas(
        _parse_batches, schema=schemas.MESSAGES)
