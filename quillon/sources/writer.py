"""Mails as .eml files, for tests and round trips."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from email.message import EmailMessage

import pyarrow as pa
from pyspark.sql import DataFrame


def to_eml(subject: str, sender: str, html: str) -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"] = subject, sender
    m.set_content("plain text stand-in")
    m.add_alternative(html, subtype="html", cte="base64")
    return m.as_bytes()


#: Kinds of mails that to_form makes.
FORMS = 8


def to_form(n: int, html: str) -> bytes:
    """The kind of mail that n % FORMS stands for: with and without headers, markup, images, and one that can't be read."""
    m, kind, image = EmailMessage(), n % FORMS, f"image of {n}".encode()
    if kind == 3:
        return b"Subject: lost\nMIME-Version: 1.0\nContent-Type: text/html; charset=no-such-charset\nContent-Transfer-Encoding: base64\n\nPGI+aGk8L2I+\n"
    if kind != 1:
        subject = f"Тема {n}"
        # as a header that was written in UTF-8 and read as Latin-1
        m["Subject"], m["From"] = subject.encode().decode("latin-1") if kind == 2 else subject, f"{n}@b.example"
    if kind in (0, 7):
        m.set_content("plain text stand-in")
        m.add_alternative(html, subtype="html", cte="base64")
    elif kind == 1:
        m.set_content(html, subtype="html", cte="base64")
    elif kind in (2, 4):
        m.set_content(f"plain words of page {n}")
    else:
        m.set_content("")
    if kind == 0:
        m.add_attachment(image, "image", "png", filename=f"p{n}.png", cid="<cid>")
        m.add_attachment(b"", "image", "png", filename="empty.png")
    if kind in (4, 5):
        m.add_attachment(image, "image", "gif", disposition="inline")
    if kind == 7:
        m.add_attachment(image, "image", "jpeg", cid=f"<c{n}>", disposition="inline")
    return m.as_bytes()


def write_forms(pages: DataFrame, folder: str) -> int:
    """n, html: a mail of some kind each, as n.eml."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, html = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([f"{x}.eml" for x in n]), pa.array([to_form(*r) for r in zip(n, html, strict=True)], pa.binary())], names=["file", "content"])

    return write_files(pages.select("n", "html").mapInArrow(run, "file string, content binary"), folder)


def write_files(files: DataFrame, folder: str) -> int:
    """file, content: one file each, in a folder that all executors share; a file is replaced whole. The number of files."""
    path = re.sub(r"^file:/*", "/", folder)
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{path}/.{name}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{path}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("file", "content").mapInArrow(run, "n bigint").agg({"n": "sum"}).first()[0] or 0


def write_mails(mails: DataFrame, folder: str) -> int:
    """file, subject, sender, html: one .eml file each; see write_files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mails_ = [to_eml(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mails_, pa.binary())], names=["file", "content"])

    return write_files(mails.select("file", "subject", "sender", "html").mapInArrow(run, "file string, content binary"), folder)
