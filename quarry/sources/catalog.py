"""Catalog texts: BEGIN, name, file, attribute and type by line, END."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {"Int": T.IntegerType(), "Double": T.DoubleType(), "String": T.StringType()}


@dataclass(frozen=True)
class Relation:
    name: str
    file: str
    schema: T.StructType


def parse_catalog(text: str) -> dict[str, Relation]:
    relations: dict[str, Relation] = {}
    words = iter(text.split())
    for word in words:
        if word != "BEGIN":
            raise ValueError(f"expected BEGIN, found {word}")
        try:
            name, file, fields = next(words), next(words), []
            while (attribute := next(words)) != "END":
                kind = next(words)
                if kind not in TYPES:
                    raise ValueError(f"{name}.{attribute} has the unknown type {kind}")
                fields.append(T.StructField(attribute, TYPES[kind], False))
        except StopIteration:
            raise ValueError("the catalog ends within a relation") from None
        relations[name] = Relation(name, file, T.StructType(fields))
    return relations


def show_catalog(relations: dict[str, Relation]) -> str:
    kinds = {type(v): k for k, v in TYPES.items()}
    blocks = []
    for r in relations.values():
        rows = "\n".join(f"{f.name} {kinds[type(f.dataType)]}" for f in r.schema.fields)
        blocks.append(f"BEGIN\n{r.name}\n{r.file}\n{rows}\nEND\n")
    return "\n".join(blocks)


@dataclass(frozen=True)
class Settings:
    """Where the catalog, the stored tables and the text files are."""

    catalog: str
    tables: str
    texts: str

    @staticmethod
    def parse(text: str) -> Settings:
        return Settings(*(line.strip() for line in text.splitlines() if line.strip()))
