"""Audit of code and prose: dependencies, string literals, identifiers by kind of text, nearest strings by longest matches."""

from __future__ import annotations

import ast
import difflib
import io
import math
import re
import tokenize
import tomllib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)")
_IMPORT = re.compile(r"^\s*(?:import|from)\s+([A-Za-z_]\w*)", re.MULTILINE)
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'")


def package_name(name: str) -> str:
    """The canonical form of a package name."""
    return re.sub(r"[-_.]+", "-", name).lower()


def dependencies(path: str, text: str) -> list[str]:
    """Packages that a project file, a requirements list or a Python file asks for."""
    found: list[str] = []
    if path.endswith(".toml"):
        try:
            project = tomllib.loads(text).get("project", {})
        except tomllib.TOMLDecodeError:
            return []
        listed = [*project.get("dependencies", []), *(d for group in project.get("optional-dependencies", {}).values() for d in group)]
        found = [m[1] for d in listed if (m := _NAME.match(d))]
    elif path.endswith(".txt"):
        found = [m[1] for line in text.splitlines() if not line.lstrip().startswith(("#", "-")) and (m := _NAME.match(line))]
    elif path.endswith((".py", ".pyi")):
        try:
            for node in ast.walk(ast.parse(text)):
                if isinstance(node, ast.Import):
                    found += [a.name.split(".")[0] for a in node.names]
                elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
                    found.append(node.module.split(".")[0])
                elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) and getattr(node.func, "attr", getattr(node.func, "id", "")) in ("import_module", "__import__"):
                    found.append(node.args[0].value.split(".")[0])
        except SyntaxError:
            found = _IMPORT.findall(text)
    return sorted({package_name(n) for n in found})


def literals(text: str, least: int = 20) -> list[str]:
    """String literals of Python code, or of anything by their quotes, of `least` characters and more."""
    try:
        found = [n.value for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    except (SyntaxError, ValueError):
        found = [a or b for a, b in _LITERAL.findall(text)]
    return [s for s in found if len(s) >= least]


def spans(text: str) -> list[dict]:
    """Parts of Python code by kind: comment, string, code; text that isn't Python is code."""
    out: dict[str, list[str]] = {"comment": [], "string": [], "code": []}
    kinds = {tokenize.COMMENT: "comment", tokenize.STRING: "string", getattr(tokenize, "FSTRING_MIDDLE", -1): "string"}
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            out[kinds.get(t.type, "code")].append(t.string)
    except (tokenize.TokenError, SyntaxError):
        out = {"comment": [], "string": [], "code": [text]}
    return [{"kind": k, "text": " ".join(v)} for k, v in out.items() if v]


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|</?[A-Za-z][^<>]*>", re.DOTALL)


def span_rows(text: str | None, suffix: str) -> list[tuple[str, int, str]]:
    """(kind, place, text) of the parts of a file: comment, tag and text of markup; comment, string and code of anything else; binary if it has a NUL."""
    if text is None:
        return []
    if "\0" in text[:8192]:
        return [("binary", 0, "")]
    if suffix not in (".html", ".htm", ".xml"):
        return [(s["kind"], k, s["text"]) for k, s in enumerate(spans(text))]
    out, at = [], 0
    for m in _MARKUP.finditer(text):
        if m.start() > at:
            out.append(("text", at, text[at : m.start()]))
        out.append(("comment" if m[0].startswith("<!--") else "tag", m.start(), m[0]))
        at = m.end()
    return out + ([("text", at, text[at:])] if at < len(text) else [])


@F.udtf(returnType="kind string, place int, part string")
class Spans:
    """span_rows() as a table function, for lateral joins: spans(text, suffix)."""

    def eval(self, text: str, suffix: str):
        yield from span_rows(text, suffix)


def spanned(files: DataFrame, text: str, suffix: str) -> DataFrame:
    """The columns of `files` but the text, with kind, place and part of each span; `suffix` is an SQL expression."""
    spark = files.sparkSession
    spark.udtf.register("veinstone_spans", Spans)
    names = ", ".join(f"f.`{c}`" for c in files.columns if c != text)
    return spark.sql(f"SELECT {names}, s.kind, s.place, s.part FROM {{files}} AS f, LATERAL veinstone_spans(f.`{text}`, {suffix}) AS s", files=files)


def _dependencies(paths: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([dependencies(p, t or "") for p, t in zip(paths, texts, strict=True)], dtype=object)


def _literals(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: literals(t or ""))


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: spans(t or ""))


def dependency_rows(files: DataFrame) -> DataFrame:
    """rel_path, package of files (rel_path, text)."""
    return files.select("rel_path", F.explode(F.pandas_udf(_dependencies, "array<string>")("rel_path", "text")).alias("package"))


def dependency_hits(found: DataFrame, rules: DataFrame) -> DataFrame:
    """rel_path, package, rule, level: packages that a rule (rule, level) names, but for marks, or that begin with one of five letters and more.

    A package meets rules by its beginnings, as keys of a join: all of it, and those of five letters and more.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[-_.]", "")
    own = found.withColumn("_bare", bare(F.col("package")))
    heads = F.when(F.length("_bare") > 5, F.transform(F.sequence(F.lit(5), F.length("_bare")), lambda n: F.left("_bare", n))).otherwise(F.array("_bare"))
    keyed = own.withColumn("_head", F.explode(heads)).drop("_bare")
    return keyed.join(rules.withColumn("_rule", bare(F.col("rule"))), F.col("_head") == F.col("_rule")).drop("_head", "_rule")


def literal_rows(files: DataFrame) -> DataFrame:
    return files.select("rel_path", F.explode(F.pandas_udf(_literals, "array<string>")("text")).alias("literal"))


class Matcher:
    """Finds many names in a text in one pass: an automaton whose states are beginnings of names.

    Folded characters lead from state to state; where none fits, the state falls back to the longest end that is a beginning
    too. A hit counts if no letter, digit or underscore of ASCII stands before or behind it.
    """

    def __init__(self, names: list[str]):
        self.names = [n for n in dict.fromkeys(names) if n]
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, name in enumerate(self.names):
            at = 0
            for c in map(str.lower, name):
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.ends.append([])
                at = self.moves[at][c]
            self.ends[at].append(k)
        self.back, level = [0] * len(self.moves), list(self.moves[0].values())
        while level:  # by length, so that what a state falls back to is finished
            below = []
            for state in level:
                for c, to in self.moves[state].items():
                    at = self.back[state]
                    while at and c not in self.moves[at]:
                        at = self.back[at]
                    self.back[to] = self.moves[at].get(c, 0)
                    self.ends[to] += self.ends[self.back[to]]
                    below.append(to)
            level = below
        self.skip = re.compile("[" + re.escape("".join(sorted(self.moves[0]))) + "]", re.IGNORECASE) if self.moves[0] else None

    def counts(self, text: str) -> dict[int, int]:
        """Hits of the names by their number."""
        found: dict[int, int] = {}
        at, k, n, moves = 0, 0, len(text), self.moves
        while k < n and self.skip is not None:
            if not at:  # nothing begun: on to the next character that begins a name
                here = self.skip.search(text, k)
                if here is None:
                    break
                k = here.start()
            c = text[k].lower()
            while at and c not in moves[at]:
                at = self.back[at]
            at = moves[at].get(c, 0)
            k += 1
            for name in self.ends[at]:
                begin = k - len(self.names[name])
                if not (begin and _WORD.match(text[begin - 1])) and not (k < n and _WORD.match(text[k])):
                    found[name] = found.get(name, 0) + 1
        return found


_WORD = re.compile("[A-Za-z0-9_]")


def name_hits(texts: DataFrame, names: list[str], column: str = "text") -> DataFrame:
    """The columns of `texts` but the text, and name and hits of each name in it; case doesn't count, names are whole words. One pass over a text."""
    matcher, keep = Matcher(names), [f for f in texts.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which, hits = [], [], []
            for k, text in enumerate(batch.column(len(keep))):
                for name, n in matcher.counts(text.as_py() or "").items():
                    rows.append(k)
                    which.append(matcher.names[name])
                    hits.append(n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.array(which, pa.string()), pa.array(hits, pa.int32())], names=[*(f.name for f in keep), "name", "hits"])

    own = texts.select(*[f.name for f in keep])
    return texts.select(*[f.name for f in keep], column).mapInArrow(run, own.schema.add("name", "string").add("hits", "integer"))


def identifier_hits(files: DataFrame, names: list[str]) -> DataFrame:
    """rel_path, kind (of span), name, hits of files (rel_path, text)."""
    parts = files.select("rel_path", F.explode(F.pandas_udf(_spans, "array<struct<kind:string,text:string>>")("text")).alias("part")).select("rel_path", "part.*")
    return name_hits(parts, names)


#: Strings in a block, and the classes that characters are counted by.
STRINGS, CLASSES = 512, 128


def character_counts(strings: list[str]) -> np.ndarray:
    """How often each class of characters is in each string; what two strings share of these is what they can match at most."""
    out = np.zeros((len(strings), CLASSES), np.int32)
    for k, s in enumerate(strings):
        out[k] = np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES, minlength=CLASSES)
    return out


def _matched(a: str, b: str) -> int:
    return sum(block.size for block in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def compared(targets: list[str], references: list[str], threshold: float, least: int) -> tuple[list[tuple], int]:
    """(s, r, similarity, matched, violation) of the best reference of each target that reaches the threshold; and how many pairs were matched in full.

    The ratio is 2 * matched / (lengths); characters in common bound what is matched, and a pair that can't beat
    the best so far is not matched, unless it may be the first violation: `least` matched characters.
    """
    size = np.array([len(r) for r in references])
    counts, out, done = character_counts(references), [], 0
    for s, own in zip(targets, character_counts(targets), strict=True):
        most = 2 * np.minimum(counts, own).sum(axis=1) / (size + len(s))
        best, violating = (0.0, "", 0), False
        for k in np.argsort(-most, kind="stable"):
            if most[k] < threshold or (most[k] < best[0] and (violating or most[k] * (size[k] + len(s)) / 2 < least)):
                if most[k] < threshold or violating:
                    break
                continue
            done += 1
            found = _matched(s, references[k])
            ratio = 2 * found / (size[k] + len(s))
            if ratio >= threshold:
                violating |= found >= least
                best = max(best, (float(ratio), references[k], found))
        if best[1]:
            out.append((s, best[1], best[0], best[2], violating))
    return out, done


def nearest_strings(target: DataFrame, reference: DataFrame, threshold: float = 0.6, least: int = 40) -> DataFrame:
    """s, r, similarity, matched, violation: the most similar reference string (column s) of each target string, of `threshold` and more; ties to the greater r.

    A violation is a target of which some reference of the threshold matches `least` characters. Lengths bound the ratio,
    2 * shorter / (shorter + longer), so strings meet by classes of a constant factor, each in its own and the next ones. They
    meet in blocks of bounded size, where the characters that two strings have in common bound the ratio once more; no pair that may
    reach the threshold is left out, and pairs are never rows.
    """
    step = -math.log(threshold / (2 - threshold))
    klass = F.floor(F.log(F.length("s").cast("double")) / step).cast("int")
    kind = "class int, block long, strings array<string>"

    def blocks(rows: DataFrame) -> DataFrame:
        each = rows.select("s").where("length(s) > 0").distinct().select("s", klass.alias("class"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[str]] = {}
            base = TaskContext.get().partitionId() << 32
            for batch in batches:
                for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = held.setdefault(c, [])
                    own.append(s)
                    if len(own) == STRINGS:
                        base += 1
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([base]), pa.array([held.pop(c)], pa.list_(pa.string()))], names=["class", "block", "strings"])
            for c, own in held.items():
                base += 1
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([base]), pa.array([own], pa.list_(pa.string()))], names=["class", "block", "strings"])

        return each.mapInArrow(run, kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, _ = compared(s, r, threshold, least)
                columns = list(zip(*found, strict=True)) or [()] * 5
                types = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["s", "r", "similarity", "matched", "violation"])

    own = blocks(target).select(F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("k"), "strings")
    other = blocks(reference).select("class", F.col("strings").alias("others"))
    met = own.join(other, F.col("k") == F.col("class")).select("strings", "others").repartition(own.sparkSession.sparkContext.defaultParallelism)
    each = met.mapInArrow(meet, "s string, r string, similarity double, matched int, violation boolean")
    best = each.groupBy("s").agg(F.max(F.struct("similarity", "r", "matched")).alias("best"), F.bool_or("violation").alias("violation"))
    return best.select("s", "best.r", "best.similarity", "best.matched", "violation")


def worst_first(matches: DataFrame, n: int) -> DataFrame:
    """The first n of matches (s, similarity, matched, violation): violations first, then by similarity, matched characters and string."""
    return matches.orderBy(F.desc("violation"), F.desc("similarity"), F.desc("matched"), "s").limit(n)
