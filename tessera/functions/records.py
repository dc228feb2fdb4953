"""Record update, modifiers, safe navigation and arithmetic over dicts of columns or struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.base import col
from tessera.operators.errors import RelError


def as_dict(record) -> dict:
    """A step's record variable, or a dict, as a dict of columns."""
    return dict(record) if isinstance(record, dict) else {f: record[f] for f in record._var.fields}


def with_(record, **changes) -> dict:
    """``{r with f = e}``: the fields must be there."""
    fields = as_dict(record)
    if missing := set(changes) - set(fields):
        raise RelError(f"no field '{sorted(missing)[0]}' to update")
    return fields | {k: col(v) for k, v in changes.items()}


def extend(record, on_clash: str = "error", **new) -> dict:
    """Adds fields; a name that is there already is an error, skipped, or replaced."""
    fields = as_dict(record)
    for k, v in new.items():
        if k in fields and on_clash == "error":
            raise RelError(f"field '{k}' is there already")
        if k not in fields or on_clash == "replace":
            fields[k] = col(v)
    return fields


def replace(record, on_missing: str = "error", **new) -> dict:
    fields = as_dict(record)
    for k, v in new.items():
        if k in fields:
            fields[k] = col(v)
        elif on_missing == "error":
            raise RelError(f"no field '{k}' to replace")
    return fields


def remove(record, *names: str, on_missing: str = "error") -> dict:
    fields = as_dict(record)
    for n in names:
        if n not in fields and on_missing == "error":
            raise RelError(f"no field '{n}' to remove")
        fields.pop(n, None)
    return fields


def rename(record, **names: str) -> dict:
    """old=new"""
    fields = as_dict(record)
    for old in names:
        if old not in fields:
            raise RelError(f"no field '{old}' to rename")
    out = {names.get(k, k): v for k, v in fields.items()}
    if len(out) != len(fields):
        raise RelError("two fields of one name")
    return out


def navigate(value: Column, kind: T.DataType, field: str) -> Column:
    """``e?.f``: through a missing record to a missing field, through a collection to each element's field."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: navigate(x, kind.elementType, field))
    return value.getField(field)
