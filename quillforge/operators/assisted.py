"""Chunkers that ask a language model. The model is a ``CompletionClient``, made once in each worker by a factory that is passed in; no model is bundled.

An answer that can't be read never fails a row: propositions are then empty, groups are new, windows end where they would without a model.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
from collections.abc import Callable, Iterable
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunkers
from .arrow import flat_map, per_group


class CompletionClient(Protocol):
    def complete(self, message: str, system: str | None = None, schema: dict | None = None, attachments: list | None = None) -> str: ...


Factory = Callable[[], CompletionClient]


class Scripted:
    """A client for tests: the first answer whose key occurs in the message, else ``default``."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = ""):
        self.answers, self.default, self.asked = answers or {}, default, []

    def complete(self, message, system=None, schema=None, attachments=None) -> str:
        self.asked.append(message)
        return next((a for k, a in self.answers.items() if k in message), self.default)


_models: dict[str, Factory] = {}


def register_model(alias: str, factory: Factory) -> None:
    _models[alias] = factory


def get_model(alias: str | None = None) -> Factory:
    """A registered factory, the first one for None."""
    if not _models or (alias and alias not in _models):
        raise KeyError(f"no model {alias or ''} is registered")
    return _models[alias] if alias else next(iter(_models.values()))


def fenced_json(answer: str) -> Any:
    """The JSON of an answer's first fenced block, else None."""
    m = re.search(r"```[^\n]*\n(.*?)\n```", answer or "", re.S)
    try:
        return json.loads(m[1]) if m else None
    except ValueError:
        return None


def _once(factory: Factory) -> Callable[[], CompletionClient]:
    made: list[CompletionClient] = []

    def client() -> CompletionClient:
        if not made:
            made.append(factory())
        return made[0]

    return client


def lumber(df: DataFrame, factory: Factory | None = None, size: int = 256, **kw) -> DataFrame:
    """``chunkers.lumber_chunks`` with a model that names, in fenced JSON, the split_index where a new subject begins."""
    if factory is None:
        return chunkers.lumber_chunks(df, size, **kw)

    def make():
        client = factory()

        def choose(at: int, window: list[str]) -> int | None:
            said = fenced_json(client.complete("Numbered passages of one text follow. Name the number of the first that turns to another subject.\n" + "\n".join(window), schema={"split_index": "int"}))
            try:
                return int(said["split_index"])
            except (TypeError, KeyError, ValueError):
                return None

        return choose

    return chunkers.lumber_chunks(df, size, make_choose=make, **kw)


def propositions(df: DataFrame, factory: Factory, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, pos, content, originals): the plain statements that a model's fenced JSON list finds in each text."""
    kind, client = dict(df.dtypes)[id_col], _once(factory)

    def one(row: dict):
        if not row["__text"]:
            return
        said = fenced_json(client().complete("State each fact of this passage as one sentence that stands alone; answer with a JSON list.\n" + row["__text"]))
        for k, p in enumerate(x for x in said if isinstance(x, str)) if isinstance(said, list) else []:
            yield {id_col: row[id_col], "pos": k, "content": p, "originals": [str(row[id_col])]}

    own = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return flat_map(own, one, f"{id_col} {kind}, pos bigint, content string, originals array<string>")


def agentic(df: DataFrame, factory: Factory, regenerate: bool = False, group_col: str = "doc_id", order_col: str = "pos", text_col: str = "content") -> DataFrame:
    """(group_col, group_index, group_id, title, summary, content, originals): statements of a document gathered one after another into the group that the model names, else a new one."""
    kind, client = dict(df.dtypes)[group_col], _once(factory)

    def one(rows: list[dict]):
        groups: list[dict] = []
        ask = client().complete
        for r in sorted(rows, key=lambda r: r[order_col]):
            text = r["__text"]
            if not text:
                continue
            outline = "".join(f"Group {g['id']}: {g['title']}. {g['summary']}\n" for g in groups)
            said = ask(f"{outline}Which group does this statement belong to, if any?\n{text}") if groups else ""
            home = next((g for g in groups if g["id"] in said), None)
            if home is None:
                summary = ask(f"Summarise a new group that holds this statement.\n{text}")
                gid = hashlib.sha256(f"{r[group_col]}/{len(groups)}".encode()).hexdigest()[:6]
                groups.append({"id": gid, "title": ask(f"Give a title for this summary.\n{summary}"), "summary": summary, "texts": [text], "from": [str(r[order_col])]})
                continue
            home["texts"].append(text)
            home["from"].append(str(r[order_col]))
            if regenerate:
                home["summary"] = ask("Bring this summary up to date.\n" + home["summary"] + "\n" + "\n".join(home["texts"]))
                home["title"] = ask("Bring this title up to date.\n" + home["title"] + "\n" + home["summary"])
        for k, g in enumerate(groups):
            yield {group_col: rows[0][group_col], "group_index": k, "group_id": g["id"], "title": g["title"], "summary": g["summary"], "content": " ".join(g["texts"]), "originals": g["from"]}

    own = df.select(F.col(group_col), F.col(order_col), F.col(text_col).alias("__text"))
    return per_group(own, [group_col], one, f"{group_col} {kind}, group_index bigint, group_id string, title string, summary string, content string, originals array<string>")


def toc_levels(headers: DataFrame, factory: Factory, group_col: str = "doc_id", order_col: str = "ord", title_col: str = "content") -> DataFrame:
    """(group_col, order_col, level): the level that the model gives each header; those that it leaves out are missing, ids that don't exist are ignored."""
    kinds, client = dict(headers.dtypes), _once(factory)

    def one(rows: list[dict]):
        rows = sorted(rows, key=lambda r: r[order_col])
        said = client().complete("Give these headers as lines of # signs and ID `n`, one # for each level.\n" + "\n".join(f"ID `{i}`: {(r[title_col] or '').strip()}" for i, r in enumerate(rows)))
        found = {int(m[1]): line.count("#") for line in said.split("\n") if (m := re.search(r"ID `(\d+)`", line))}
        for i, level in found.items():
            if i < len(rows):
                yield {group_col: rows[i][group_col], order_col: rows[i][order_col], "level": level}

    return per_group(headers.select(group_col, order_col, title_col), [group_col], one, f"{group_col} {kinds[group_col]}, {order_col} {kinds[order_col]}, level bigint")


def as_tool(fn: Callable) -> dict:
    """{name, description, parameters} of an operator, from its signature and docstring."""
    kinds = {int: "integer", float: "number", bool: "boolean", str: "string", "int": "integer", "float": "number", "bool": "boolean", "str": "string"}
    params = {}
    for name, p in inspect.signature(fn).parameters.items():
        if p.kind in (p.VAR_KEYWORD, p.VAR_POSITIONAL):
            continue
        first = str(p.annotation).split("|")[0].strip() if p.annotation is not p.empty else "str"
        params[name] = {"type": kinds.get(p.annotation, kinds.get(first, "object")), "required": p.default is p.empty, **({} if p.default in (p.empty, None) else {"default": p.default})}
    return {"name": fn.__name__, "description": inspect.getdoc(fn) or "", "parameters": params}


def missing_modules(names: Iterable[str]) -> list[str]:
    """Those of an operator's optional modules that aren't installed."""
    import importlib.util

    return [n for n in names if importlib.util.find_spec(n) is None]
