"""User-defined formats: a probe as a column, a parser over files, faults kept to their file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.routing import Rule


class FormatFault(Exception):
    """A parser's own fault, with a code that is kept."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


class Formats:
    """Formats by name; a name is given once."""

    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}
        self.parsers: dict[str, tuple[Callable, str]] = {}

    def register(self, name: str, matched: Column, confidence: Column, parse: Callable[[bytes], pd.DataFrame], schema: str, private: bool = False) -> None:
        """``parse`` turns a file's bytes into rows of ``schema`` or raises ``FormatFault``."""
        if name in self.rules:
            raise ValueError(f"the format {name!r} is registered already")
        self.rules[name] = Rule(name, matched, confidence, private)
        self.parsers[name] = (parse, schema)

    def parse(self, name: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows and issues of ``files (file_id, content)``; a faulty file only gives an issue."""
        parse, schema = self.parsers[name]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                    try:
                        rows = parse(bytes(content))
                        yield rows.assign(file_id=file_id, code=None, is_issue=False)
                    except FormatFault as fault:
                        yield pd.DataFrame({"file_id": [file_id], "code": [fault.code], "is_issue": [True]})
                    except Exception:
                        yield pd.DataFrame({"file_id": [file_id], "code": ["ADAPTER_UNEXPECTED_ERROR"], "is_issue": [True]})

        def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in run(batches):
                yield rows.reindex(columns=names)

        names = ["file_id", *[f.split()[0] for f in schema.split(",")], "code", "is_issue"]
        out = files.select("file_id", "content").mapInPandas(shaped, f"file_id long, {schema}, code string, is_issue boolean")
        issues = out.where("is_issue").select("file_id", "code", F.lit("error").alias("severity"))
        return out.where("not is_issue").drop("code", "is_issue"), issues
