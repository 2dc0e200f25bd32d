"""Mail messages: headers, body and attachments, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_bytes, message_from_string
from email.message import Message
from email.utils import parsedate_to_datetime

from .html import read
from .plain import paragraphs

_ADDRESS = re.compile(r"[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.[a-z]+")
_OCTETS = re.compile(r"[0-9]{1,2}(?:\.[0-9]{1,2}){3}|[a-z0-9]{4}:(?::[a-z0-9]{4}){4}%?[0-9]*")
_NAME = re.compile(r"[a-zA-Z0-9-]*(?:\.[a-zA-Z]*){2}")
_MAPI = re.compile(r"[0-9]*(?:\.[0-9]*){3};")
_DATE = re.compile(r"[A-Za-z]{3},\s\d{1,2}\s[A-Za-z]{3}\s\d{4}\s\d{2}:\d{2}:\d{2}\s[+-]\d{4}")
_IMAGE = re.compile(r"\[image: ([^\]]+)\]")


def iso_date(value: str | None) -> str | None:
    found = _DATE.search(value or "")
    return parsedate_to_datetime(found[0]).isoformat() if found else None


def headers(msg: Message) -> Iterator[dict]:
    """A row for each header; a Received header gives its hosts, its id and its time."""
    for key, value in msg.raw_items():
        value = str(value)
        if key in ("To", "From"):
            found = _ADDRESS.findall(value.lower())
            name = re.split(f"<{_ADDRESS.pattern}>", value.lower())[0].title().strip()
            yield {"kind": "Recipient" if key == "To" else "Sender", "name": name, "text": found[0] if found else value}
        elif key == "Subject":
            yield {"kind": "Subject", "text": value}
        elif key == "Received":
            for name, ip in zip(_NAME.findall(value), _OCTETS.findall(value)):
                yield {"kind": "ReceivedInfo", "name": name, "text": ip}
            ids = _MAPI.findall(value)
            if ids:
                yield {"kind": "ReceivedInfo", "name": "mapi_id", "text": ids[0].replace(";", "")}
            if _DATE.search(value):
                yield {"kind": "ReceivedInfo", "name": "received_datetimetz", "text": str(parsedate_to_datetime(_DATE.search(value)[0]))}
        else:
            yield {"kind": "MetaData", "name": key, "text": value}


def body_of(msg: Message, content_source: str) -> str:
    """The last part of that kind that isn't attached, decoded."""
    out = ""
    for part in msg.walk():
        if part.get_content_disposition() is None and part.get_content_type() == content_source:
            raw = part.get_payload(decode=True) or b""
            try:
                out = raw.decode(part.get_content_charset() or "utf-8")
            except (LookupError, UnicodeDecodeError):
                out = raw.decode("latin-1")
    return out


def attachments(msg: Message) -> Iterator[tuple[str, bytes]]:
    """(name, content) of what is attached."""
    for part in msg.walk():
        if part.get_content_disposition() in ("attachment", "inline") and part.get_filename():
            yield part.get_filename(), part.get_payload(decode=True) or b""


def read_mail(content: bytes | str, content_source: str = "text/html", include_headers: bool = False, max_partition: int = 1500, with_attachments: bool = False) -> Iterator[dict]:
    """The body's elements, all with the message's metadata; headers before and attached texts after them if wanted."""
    if content_source not in ("text/html", "text/plain"):
        raise ValueError(f"no such content source: {content_source}")
    msg = message_from_bytes(content) if isinstance(content, bytes) else message_from_string(content)
    split = lambda v: [x.strip() for x in str(v).split(",")] if v is not None else None
    meta = {"sent_from": split(msg.get("From")), "sent_to": split(msg.get("To")), "subject": msg.get("Subject"), "date": iso_date(msg.get("Date"))}
    if include_headers:
        for h in headers(msg):
            yield h | meta
    body = body_of(msg, content_source)
    rows = read(body) if content_source == "text/html" else paragraphs(body, max_partition)
    for row in rows:
        image = _IMAGE.search(row["text"]) if row.get("kind") != "Table" else None
        if image:
            rest = _IMAGE.sub("", row["text"], count=1).strip()
            if rest:
                yield row | meta | {"text": rest}
            yield {"kind": "Image", "text": image[1]} | meta
        else:
            yield row | meta
    if with_attachments:
        for name, data in attachments(msg):
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            for row in read(text) if name.lower().endswith((".html", ".htm")) else paragraphs(text, max_partition):
                yield row | meta | {"attachment_name": name, "attached_to_filename": msg.get("Subject")}
