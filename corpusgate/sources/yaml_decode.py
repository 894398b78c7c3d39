"""The one per-row Python helper: file bytes → typed manifest fields (SC6, MV1, MV2).

A file's bytes become the nested manifest of `sources.manifests`, with null
where a field is missing or not convertible, and a list of problems in the
validation library's wording: unknown keys, wrong types, missing structures.
Whatever goes wrong with one file is that file's problem and nobody else's.
Missing leaf fields stay null here; the rules report those.
"""
from __future__ import annotations

import json
import re

import pyarrow as pa

# --- fixed values: the manifest's fields, in the library's order -------------
# kind, required, default; kinds ending in '?' may be null
SOURCE = {"path": ("str", None), "name": ("str?", None), "split": ("str", "train"), "weight": ("float", None),
          "text_column": ("str?", None), "text_template": ("str?", None), "revision": ("str?", None),
          "license": ("str?", None)}
DATASET = {"path": ("str", None), "name": ("str?", None), "split": ("str", None)}
BENCHMARK = {"name": ("str", None), "harness": ("choice", None), "task": ("str?", None), "num_fewshot": ("int?", None),
             "metric": ("str", None), "higher_is_better": ("bool", None), "dataset": ("HubSplit", None),
             "why": ("str?", None)}
PROPOSER = {"github": ("str", None), "contact": ("str?", None)}
DATA = {"dataset_sources": ("list", None), "sequence_length": ("int", 4096)}
SUGGESTED = {"steps": ("int?", None), "batch_size": ("int?", None)}
TOP = {"name": ("str", None), "title": ("str", None), "proposer": ("Proposer", None), "description": ("str", None),
       "data": ("Data", None), "benchmarks": ("list", None), "hypothesis": ("str", None), "evidence": ("str", None),
       "suggested_training": ("SuggestedTraining?", None), "contamination": ("str", None)}
SECTIONS = {"name": 1, "title": 2, "proposer": 3, "description": 4, "data": 5, "benchmarks": 6, "hypothesis": 7,
            "evidence": 8, "suggested_training": 9, "contamination": 10}

DIGITS = 38  # of a whole number that a manifest can hold

# --- fixed values: the library's wording --------------------------------------
EXTRA = "Extra inputs are not permitted"
REQUIRED = "Field required"
STRING = "Input should be a valid string"
NUMBER = "Input should be a valid number"
NUMBER_TEXT = "Input should be a valid number, unable to parse string as a number"
INTEGER = "Input should be a valid integer"
INTEGER_TEXT = "Input should be a valid integer, unable to parse string as an integer"
INTEGER_SIZE = f"Input should be a valid integer, of at most {DIGITS} digits"  # our own limit, not the library's
INTEGER_PART = "Input should be a valid integer, got a number with a fractional part"
FINITE = "Input should be a finite number"
BOOLEAN = "Input should be a valid boolean"
BOOLEAN_TEXT = "Input should be a valid boolean, unable to interpret input"
CHOICE = "Input should be 'lm_eval' or 'eval_loss'"
LIST = "Input should be a valid list"
MODEL = "Input should be a valid dictionary or instance of {name}"
TEXT_KEYS = "Keys should be strings"
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")

_WHOLE = re.compile(r"[+-]?[0-9]+(?:\.0*)?\Z")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z|[+-]?(?:inf|infinity|nan)\Z", re.I)


def convert(kind: str, value):
    """(value, problem): the value as the library's lax mode takes it."""
    if value is None and kind.endswith("?"):
        return None, None
    kind = kind.rstrip("?")
    if kind == "str":
        return (value, None) if isinstance(value, str) else (None, STRING)
    if kind == "choice":  # the rule itself checks which text it is
        return (value, None) if isinstance(value, str) else (None, CHOICE)
    if kind == "float":
        if isinstance(value, (bool, int, float)):
            try:
                return float(value), None
            except OverflowError:
                return None, NUMBER
        if isinstance(value, str):
            text = value.strip()
            return (float(text), None) if _NUMBER.match(text) else (None, NUMBER_TEXT)
        return None, NUMBER
    if kind == "int":
        if isinstance(value, float):
            if value != value or value in (float("inf"), float("-inf")):
                return None, FINITE
            if value != int(value):
                return None, INTEGER_PART
        elif isinstance(value, str):
            if not _WHOLE.match(value.strip()):
                return None, INTEGER_TEXT
            value = value.strip().partition(".")[0]
            if len(value) > 4000:
                return None, INTEGER_TEXT
        elif not isinstance(value, int):
            return None, INTEGER
        value = int(value)
        return (value, None) if abs(value) < 10 ** DIGITS else (None, INTEGER_SIZE)
    if isinstance(value, bool):
        return value, None
    if isinstance(value, (int, float)):
        return (bool(value), None) if value in (0, 1) else (None, BOOLEAN_TEXT)
    if isinstance(value, str):
        text = value.lower()
        return (text in TRUE_TEXTS, None) if text in TRUE_TEXTS + FALSE_TEXTS else (None, BOOLEAN_TEXT)
    return None, BOOLEAN


class Reader:
    """Walks one document along the declared fields; unknown parts are named, never entered."""

    def __init__(self):
        self.problems: list[dict] = []

    def add(self, sec: int, item: int, sub: int, loc: str, msg: str) -> None:
        self.problems.append({"sec": sec, "item": item, "sub": sub, "loc": loc, "msg": msg})

    def fields(self, node: dict, declared: dict, sec: int, item: int, loc: str, sub: int | None = None) -> dict:
        """The leaf fields of a mapping, and its unknown keys as problems. `sub`: one order key for all."""
        out = {}
        for place, (key, (kind, default)) in enumerate(declared.items(), 1):
            if key not in node:
                out[key] = default
            elif kind[0].islower() and kind != "list":
                out[key], problem = convert(kind, node[key])
                if problem:
                    self.add(sec, item, sub or place, loc + key, problem)
        for key in node:
            if not isinstance(key, str):
                self.add(sec, item, sub or 8, f"{loc}{key}", TEXT_KEYS)
            elif key not in declared:
                self.add(sec, item, sub or 8, loc + key, EXTRA)
        return out

    def struct(self, value, declared: dict, model: str, sec: int, item: int, sub: int, loc: str):
        """A nested mapping as a dict, or None with a problem."""
        if not isinstance(value, dict):
            self.add(sec, item, sub, loc, MODEL.format(name=model))
            return None
        return self.fields(value, declared, sec, item, loc + ".", sub)

    def items(self, value, declared: dict, model: str, sec: int, loc: str) -> tuple[list, int]:
        """The mappings of a list and its length as written (-1: not a list)."""
        if not isinstance(value, list):
            self.add(sec, -1, 0, loc, LIST)
            return [], -1
        out = []
        for i, one in enumerate(value):
            at = f"{loc}.{i}"
            if isinstance(one, dict):
                row = self.fields(one, declared, sec, i, at + ".")
                if "dataset" in declared and "dataset" in one:
                    row["dataset"] = self.struct(one["dataset"], DATASET, "HubSplit", sec, i, 7, at + ".dataset")
            else:
                self.add(sec, i, 0, at, MODEL.format(name=model))
                row = {}
            out.append(row | {"pos": i + 1})
        return out, len(value)

    def manifest(self, doc: dict) -> dict:
        s = SECTIONS
        m: dict = {}
        for key, (kind, _) in TOP.items():
            if key in doc and kind == "str":
                m[key], problem = convert(kind, doc[key])
                if problem:
                    self.add(s[key], -1, 0, key, problem)
        for key in doc:
            if key not in TOP:
                self.add(s["contamination"], 1, 0, key, EXTRA)
        if "proposer" in doc:
            m["proposer"] = self.struct(doc["proposer"], PROPOSER, "Proposer", s["proposer"], -1, 0, "proposer")
        if doc.get("suggested_training") is not None:
            m["suggested_training"] = self.struct(doc["suggested_training"], SUGGESTED, "SuggestedTraining",
                                                  s["suggested_training"], -1, 0, "suggested_training")
        n_sources = n_benchmarks = -1
        m["data"] = {"dataset_sources": [], "sequence_length": 4096}
        if "data" not in doc:
            self.add(s["data"], -1, 0, "data", REQUIRED)
        elif not isinstance(doc["data"], dict):
            self.add(s["data"], -1, 0, "data", MODEL.format(name="Data"))
        else:
            data = doc["data"]
            found = self.fields(data, DATA, s["data"], 1000, "data.")
            length = found["sequence_length"]
            # a wrong type is reported already; 4096 keeps the rule silent. No other number of any size is allowed
            m["data"]["sequence_length"] = 4096 if length is None else length if abs(length) < 1 << 31 else 0
            if "dataset_sources" in data:
                m["data"]["dataset_sources"], n_sources = self.items(
                    data["dataset_sources"], SOURCE, "DatasetSource", s["data"], "data.dataset_sources")
            else:
                self.add(s["data"], -1, 0, "data.dataset_sources", REQUIRED)
        if "benchmarks" in doc:
            m["benchmarks"], n_benchmarks = self.items(doc["benchmarks"], BENCHMARK, "Benchmark", s["benchmarks"],
                                                       "benchmarks")
        else:
            m["benchmarks"] = []
            self.add(s["benchmarks"], -1, 0, "benchmarks", REQUIRED)
        # a list over its limit is reported by its length alone; its items need not travel
        if n_sources > 4:
            m["data"]["dataset_sources"] = []
        if n_benchmarks > 5:
            m["benchmarks"] = []
        return {"m": m, "n_sources": n_sources, "n_benchmarks": n_benchmarks}


# One line of text that JSON and YAML read alike: printable, no line ends or marks that YAML treats as such, and only
# escapes that both have.
_ONE_LINE = re.compile(r'\{(?:[ -\[\]-~\u00a1-\u1fff\u3000-\ud7ff]++|\\["\\bfnrt])*+\Z')
_YAML_FLOAT = re.compile(r"-?[0-9]+\.[0-9]+(?:[eE][+-][0-9]+)?\Z")
_KEY_CHARS = 1000  # YAML takes no longer keys
_DEPTH = 100  # brackets of a document that is no deeper than either reader goes


def _json_float(text: str) -> float:
    if not _YAML_FLOAT.match(text):  # `1e5`, `1.0E10`: text for YAML
        raise ValueError(text)
    return float(text)


def _json_refused(text: str) -> None:
    raise ValueError(text)


def _json_pairs(pairs: list) -> dict:
    if any(len(key) > _KEY_CHARS for key, _ in pairs):
        raise ValueError("long key")
    return dict(pairs)


def read_json(text: str) -> dict | None:
    """The document where it is JSON that YAML reads as the same; None: YAML is to read it."""
    if not _ONE_LINE.match(text) or text.count("{") + text.count("[") > _DEPTH:
        return None
    try:
        return json.loads(text, parse_float=_json_float, parse_constant=_json_refused, object_pairs_hook=_json_pairs)
    except ValueError:
        return None


def read_manifest(content: bytes | str, file: str) -> dict:
    """One file: {'load_problem'} if it does not load, else the manifest and its problems."""
    import yaml

    try:
        text = content if isinstance(content, str) else bytes(content).decode("utf-8")
        doc = read_json(text)
        try:
            if doc is None:
                doc = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        except yaml.YAMLError:
            doc = yaml.safe_load(text)  # the pure loader gives the exact error text
    except yaml.YAMLError as exc:
        return {"load_problem": f"not valid YAML — {exc}"}
    except Exception as exc:  # noqa: BLE001 - a bad date, bad bytes, endless nesting: all this file's problem
        return {"load_problem": str(exc) or type(exc).__name__}
    if not isinstance(doc, dict):
        return {"load_problem": f"{file}: expected a mapping at the top level"}
    if not all(isinstance(key, str) for key in doc):
        return {"load_problem": "keywords must be strings"}
    reader = Reader()
    try:
        return reader.manifest(doc) | {"type_errors": reader.problems}
    except Exception as exc:  # noqa: BLE001 - for example a number too long to convert
        return {"load_problem": str(exc) or type(exc).__name__}


def _struct(declared: dict, **more: pa.DataType) -> pa.DataType:
    kinds = {"str": pa.string(), "choice": pa.string(), "float": pa.float64(), "int": pa.decimal128(DIGITS), "bool": pa.bool_()}
    return pa.struct([*((k, t) for k, t in more.items() if k == "pos"),
                      *((k, more.get(k) or kinds[kind.rstrip("?")]) for k, (kind, _) in declared.items())])


MANIFEST = _struct(
    TOP, proposer=_struct(PROPOSER), data=pa.struct([
        ("dataset_sources", pa.list_(_struct(SOURCE, pos=pa.int32()))), ("sequence_length", pa.int32())]),
    benchmarks=pa.list_(_struct(BENCHMARK, pos=pa.int32(), dataset=_struct(DATASET))),
    suggested_training=_struct(SUGGESTED))
RESULT = pa.schema([
    ("load_problem", pa.string()), ("n_sources", pa.int32()), ("n_benchmarks", pa.int32()),
    ("type_errors", pa.list_(pa.struct([("sec", pa.int32()), ("item", pa.int32()), ("sub", pa.int32()),
                                        ("loc", pa.string()), ("msg", pa.string())]))),
    ("m", MANIFEST)])


def clean(value):
    """Text that UTF-8 cannot hold (lone surrogates from escapes) with replacement marks."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    return [clean(v) for v in value] if isinstance(value, list) else value


def read_batches(batches):
    """For `mapInArrow`: a file table whose `content` column is replaced by the columns of RESULT."""
    for batch in batches:
        stems = batch.column("file_stem").to_pylist()
        rows = [clean(read_manifest(c if c is not None else b"", f"{stem}.yaml"))
                for c, stem in zip(batch.column("content").to_pylist(), stems)]
        found = pa.RecordBatch.from_pylist(rows, RESULT)
        kept = batch.select([n for n in batch.schema.names if n != "content"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *found.columns], [*kept.schema.names, *RESULT.names])
