"""Versions of schemas: a log of changes folded into append-only versions, each checked against the one that its author saw."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import is_field_key

#: action: rename (from_key to to_key, label), merge (from_key into to_key), remove (from_key). expected: the version that the author saw; null: any.
CHANGE = "workspace_id string, place long, action string, expected int, from_key string, to_key string, label string, author string"
_FIELD = "position int, key string, label string, type string, currency_default string, names array<string>"
VERSION = f"workspace_id string, place long, version int, parent int, author string, summary string, refused string, fields array<struct<{_FIELD.replace(' ', ':').replace(',:', ',')}>>"


def _changed(fields: list[dict], c) -> tuple[list[dict], str]:
    """The fields after a change and what is told about it; ValueError where it can't be made."""
    by_key = {f["key"]: f for f in fields}
    if c.from_key not in by_key:
        raise ValueError(f"{c.from_key!r} is not a field of this workspace")
    source = by_key[c.from_key]
    if c.action == "rename":
        if not is_field_key(c.to_key or ""):
            raise ValueError(f"{c.to_key!r} is not a usable field key")
        if c.to_key != c.from_key and c.to_key in by_key:
            raise ValueError(f"{c.to_key!r} is already a field of this workspace")
        label = c.label or source["label"]
        new = source | {"key": c.to_key, "label": label, "names": list(dict.fromkeys([c.to_key, *source["names"]]))}
        return [new if f is source else f for f in fields], f"You renamed '{source['label']}' to '{label}'."
    rest = [f for f in fields if f is not source]
    if c.action == "remove":
        if not rest:
            raise ValueError("a schema needs a field")
        return rest, f"You removed '{source['label']}'."
    if c.action != "merge" or c.to_key not in by_key or c.to_key == c.from_key:
        raise ValueError("a merge needs two fields of this workspace")
    target = by_key[c.to_key]
    if target["type"] != source["type"]:
        raise ValueError(f"'{source['label']}' holds {source['type']} values and '{target['label']}' holds {target['type']}")
    new = target | {"names": list(dict.fromkeys([*target["names"], *source["names"]]))}
    return [new if f is target else f for f in rest], f"You merged '{source['label']}' into '{target['label']}'."


def versions(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """VERSION rows: version 1, the fields as given, in place null, then a row for each change of `changes`, in the order of its place.

    A change is refused, with the reason and without a version, if it can't be made, or if its author saw another version than the
    latest: of two writers of one version the first wins. A field keeps its former keys as names, which count at reading time, so
    renaming rewrites no value; the fields of any version are at hand. Workspaces are folded each by itself, and have some dozen fields;
    a workspace with changes but without fields has no version.
    """

    def fold(key: tuple, own: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame([], columns=[c.split()[0] for c in VERSION.split(", ")[:8]])
        now = [{**f, "names": list(f["names"])} for f in own.sort_values("position").drop(columns="workspace_id").to_dict("records")]
        now = [{k: (None if v is None or v != v else v) if k != "names" else v for k, v in f.items()} for f in now]
        out, last = [(key[0], None, 1, None, "model_auto", "First schema.", None, now)], 1
        for c in log.sort_values("place").itertuples():
            try:
                if c.expected == c.expected and c.expected is not None and int(c.expected) != last:
                    raise ValueError(f"version {int(c.expected)} is not the latest, {last} is")
                now, summary = _changed(now, c)
                now = [f | {"position": i} for i, f in enumerate(now)]
                out.append((key[0], c.place, last + 1, last, c.author, summary, None, now))
                last += 1
            except ValueError as e:
                out.append((key[0], c.place, None, last, c.author, None, str(e), None))
        names = ["workspace_id", "place", "version", "parent", "author", "summary", "refused", "fields"]
        return pd.DataFrame(out, columns=names).astype({"place": "Int64", "version": "Int32", "parent": "Int32"})

    asked = changes.select("workspace_id", "place", "action", "expected", "from_key", "to_key", "label", "author")
    return fields.select("workspace_id", "position", "key", "label", "type", "currency_default", "names").groupBy("workspace_id").cogroup(asked.groupBy("workspace_id")).applyInPandas(fold, VERSION)


def fields_at(log: DataFrame, version: int | None = None) -> DataFrame:
    """The fields (rows of plans.shared.FIELD) of each workspace's latest version, or of its latest up to `version`."""
    rows = log.where("version is not null") if version is None else log.where(F.col("version") <= version)
    return rows.groupBy("workspace_id").agg(F.max_by("fields", "version").alias("fields")).select("workspace_id", F.inline("fields"))
