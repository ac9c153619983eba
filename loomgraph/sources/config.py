"""Configurations: JSON files with relative paths, the prefix of a wiki, and blacklists."""

from __future__ import annotations

import json
import warnings
from dataclasses import make_dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: codes of the wikis whose name is <code>wiki
LANGUAGE_CODES = (
    "en zh fr ja ru pt ca fa ar fi hu id es it war ceb nl de sv ro cs ko sr ms tr min eo eu kk da bg sk hy he lt sl et uz gl nn la vo simple el ce be ka hi az th "
    "ur oc mk ta mg new tt cy tl bs br ne gu io bpy nds ku als pa su kn bar ckb ia arz"
).split()


def load_config(path: str, relative: tuple[str, ...] = (), defaults: dict | None = None, relative_to: str | None = None):
    """A JSON object as a frozen object with attributes, nested ones too; paths under the keys in `relative` start at the file's folder or relative_to."""
    base = Path(path).parent if relative_to is None else Path(relative_to)

    def grow(value):
        if isinstance(value, dict):
            fixed = {k: _joined(base, v) if k in relative else grow(v) for k, v in value.items()}
            return make_dataclass("Config", list(fixed), frozen=True)(**fixed)
        return [grow(v) for v in value] if isinstance(value, list) else value

    return grow((defaults or {}) | json.loads(Path(path).read_text()))


def _joined(base: Path, value):
    return [str(base / v) for v in value] if isinstance(value, list) else str(base / value) if isinstance(value, str) else value


def wiki_prefix(name: str) -> str:
    """enwiki for a name such as enwiki or enwiki-latest; ValueError if it is no known wiki, as its titles would match nothing."""
    for code in sorted(LANGUAGE_CODES, key=len, reverse=True):
        if name.startswith(f"{code}wiki"):
            return f"{code}wiki"
    raise ValueError(f"not a known wiki: {name}; give the prefix")


def load_blacklist(path: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity) of forbidden nodes and (child, parent) of forbidden links from a JSON file with bad_node and bad_node_pair; ids (entity, qid).

    Unknown ids are left out with a warning. The file is a hand-written list.
    """
    raw, spark = json.loads(Path(path).read_text()), ids.sparkSession
    nodes, pairs = raw.get("bad_node", []), raw.get("bad_node_pair", [])
    wanted = sorted({*nodes, *(q for p in pairs for q in p)})
    known = {r["qid"]: r["entity"] for r in ids.where(F.col("qid").isin(wanted)).select("entity", "qid").distinct().collect()} if wanted else {}
    if missing := [q for q in wanted if q not in known]:
        warnings.warn(f"{len(missing)} unknown ids in the blacklist, the first: {missing[:10]}", stacklevel=2)
    return (
        spark.createDataFrame([(int(known[q]),) for q in dict.fromkeys(nodes) if q in known], "entity long"),
        spark.createDataFrame([(int(known[a]), int(known[b])) for a, b in dict.fromkeys(map(tuple, pairs)) if a in known and b in known], "child long, parent long"),
    )
