"""Questions to an index: retrieve, screen, cite; as one plan, or step by step under budgets."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, identity, stem, structure, text
from ..operators import dense, evaluation, evidence, fusion, lexical
from ..sources.segments import Segments
from . import ingest, models
from .settings import Settings

BLOCK = 500
STRATEGIES = ("dense", "dense_mmr", "hybrid_rrf", "hybrid_rrf_rerank")


@dataclass
class Index:
    """The tables of an index's current version."""

    spark: SparkSession
    store: Segments
    settings: Settings

    @classmethod
    def open(cls, spark: SparkSession, root: str, settings: Settings = Settings()) -> Index:
        return cls(spark, ingest.opened(spark, root, settings), settings)

    @property
    def fragments(self) -> DataFrame:
        return self.store.read("fragments", ingest.FRAGMENTS)

    @property
    def sources(self) -> DataFrame:
        return self.store.read("sources", ingest.SOURCES)

    @property
    def vectors(self) -> DataFrame:
        return self.store.read("vectors", ingest.VECTORS)

    def lexical(self, field: str, words: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """query_id, id, score of all fragments with a hit in a full-text field; statistics are those of the scope."""
        scope = None if allowed is None else _scoped(self.fragments, allowed).select(F.col("fragment_id").alias("id"))
        return ingest.postings_of(self.store, field).scores(words, scope)

    def near(self, asked: list[tuple[int, list[float]]], k: int, allowed: DataFrame | None) -> DataFrame:
        """query_id, id, score: at least the k fragments nearest to each vector."""
        return dense.score_batches(_scoped(self.vectors, allowed), asked, k, "fragment_id", "embedding")

    def fields(self, wanted: dict[str, DataFrame], allowed: DataFrame | None) -> list[DataFrame]:
        """lexical() of each field with its terms."""
        return [self.lexical(field, words, allowed) for field, words in wanted.items()]

    def narrowed(self, docs: DataFrame, words: DataFrame) -> DataFrame:
        """Documents (id, tokens, length) with the tokens that are asked for, at least."""
        return docs

    def sources_of(self, rows: DataFrame) -> DataFrame:
        """The sources of rows (source_key), at least."""
        return self.sources

    def held(self, rows: DataFrame, few: bool = False) -> DataFrame:
        """Rows that are used several times; `few` are a number for each question."""
        return rows

    def status(self) -> dict:
        """Counts of the current version; never raises for a missing one."""
        manifest = self.store.read("manifest", ingest.MANIFEST)
        row = manifest.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_distinct("source_key").alias("sources")).first()
        return {"version": self.store.current(), "files": row.files, "failed": row.failed, "sources": row.sources, "fragments": self.fragments.count()}


class Scanned(Index):
    """An index of fragments and sources alone, for questions asked once: vectors and terms are made as fragments are read.

    A full-text index takes several times the disk of its texts, which a single run doesn't pay back. What is made of the
    fragments is stored once it is narrow, so that they are read once for all fields, once for vectors and once for what was found.
    """

    @property
    def vectors(self) -> DataFrame:
        return ingest.embedded(self.fragments, self.settings.model.dims)

    def near(self, asked: list[tuple[int, list[float]]], k: int, allowed: DataFrame | None) -> DataFrame:
        dims = self.settings.model.dims
        embed = functools.partial(ingest.unit_vectors, model=ingest.Hashed(dims), dims=dims)
        return dense.score_batches(_scoped(self.fragments, allowed), asked, k, "fragment_id", "text", embed=embed)

    def lexical(self, field: str, words: DataFrame, allowed: DataFrame | None) -> DataFrame:
        return self.fields({field: words}, allowed)[0]

    def fields(self, wanted: dict[str, DataFrame], allowed: DataFrame | None) -> list[DataFrame]:
        # Of each fragment only its lengths and the terms asked for are stored, in one pass.
        asked = {field: _terms(wanted[field]) if field in wanted else [] for field in ingest.FIELDS}
        docs = self.held(ingest.terms_among(_scoped(self.fragments, allowed), asked["words"], asked["english"]))
        columns = {"words": ("tokens", "length"), "english": ("stems", "stem_length")}
        made = lambda tokens, length: docs.select(F.col("fragment_id").alias("id"), F.col(tokens).alias("tokens"), F.col(length).alias("length"))
        return [lexical.bm25(made(*columns[field]), words, few=True) for field, words in wanted.items()]

    def narrowed(self, docs: DataFrame, words: DataFrame) -> DataFrame:
        return self.held(docs.withColumn("tokens", lexical.among(F.col("tokens"), _terms(words))))

    def sources_of(self, rows: DataFrame) -> DataFrame:
        return self.sources.join(F.broadcast(rows.select("source_key").distinct()), "source_key", "left_semi")

    def held(self, rows: DataFrame, few: bool = False) -> DataFrame:
        path = f"{self.store.root}/asked/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        made = self.spark.read.schema(rows.schema).parquet(path)
        # A task for each hundred rows: a file of one row needs no task with Python workers of its own.
        return made.coalesce(-(-made.count() // 100) or 1) if few else made


def _terms(words: DataFrame) -> list[str]:
    """The terms of the questions that a caller asks at once."""
    return sorted(r.term for r in words.select("term").distinct().collect())


def _scoped(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """None is everything; an empty scope is nothing."""
    return rows if allowed is None else rows.join(allowed.select("source_key").distinct(), "source_key", "left_semi")


def search(index: Index, questions: DataFrame, k: int | None = None, strategy: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, id (fragment), score, rank, origin for questions (query_id, query); blank ones find nothing."""
    s = index.settings.retrieval
    k, strategy = s.k if k is None else k, strategy or s.strategy
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    asked = questions.where(F.btrim("query") != "")
    if k <= 0:
        asked = asked.where("false")
    pool = max(k, k * (s.fetch_factor if strategy == "dense_mmr" else s.pool_factor if strategy != "dense" else 1), 1)
    # Questions are what a caller asks at once; their vectors go to the fragments in blocks, as a matrix.
    vectors = ingest.embedded(asked, index.settings.model.dims, ("query_id",), "query")
    asked_for = sorted((r.query_id, list(r.embedding)) for r in vectors.collect())
    parts = [index.near(asked_for[k : k + BLOCK], pool, allowed) for k in range(0, max(1, len(asked_for)), BLOCK)]
    near = index.held(dense.ranked(functools.reduce(DataFrame.unionByName, parts), pool), few=True)
    if strategy == "dense":
        return near.withColumn("origin", F.lit("dense"))
    if strategy == "dense_mmr":
        # Grouped selection works on numbers; fragments of the pool are numbered by their id.
        numbered = near.withColumn("n", F.row_number().over(dense.Window.partitionBy("query_id").orderBy("id")).cast("long"))
        own = numbered.join(index.vectors.select(F.col("fragment_id").alias("id"), F.col("embedding").alias("vector")), "id")
        chosen = dense.mmr(own.select("query_id", F.col("n").alias("id"), F.col("score").alias("relevance"), "vector"), k, s.lambda_)
        names = numbered.select("query_id", F.col("n").alias("m"), F.col("id").alias("fragment")).withColumnRenamed("query_id", "q")
        out = chosen.join(names, (F.col("query_id") == F.col("q")) & (F.col("id") == F.col("m")))
        return out.select("query_id", F.col("fragment").alias("id"), "score", "rank", F.lit("mmr").alias("origin"))
    words = index.held(lexical.query_terms(asked, text.tokens(text.normalize(F.col("query")))), few=True)
    stems = index.held(lexical.query_terms(asked, stem.text_stems(F.col("query"))), few=True)
    body = index.fields({"words": words, "english": stems}, allowed)
    title = _titles(index, words, allowed)
    found = index.held(dense.ranked(lexical.combined(body, title), pool), few=True)
    if strategy == "hybrid_rrf":
        return fusion.hybrid(near, found, k, s.rrf_k).withColumn("origin", F.lit("rrf"))
    fused = fusion.hybrid(near, found, pool, s.rrf_k).select("query_id", "id")
    texts = index.fragments.select(F.col("fragment_id").alias("id"), "text")
    return fusion.rerank(fused.join(asked, "query_id").join(texts, "id"), k).withColumn("origin", F.lit("rerank"))


def _titles(index: Index, words: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """BM25 over titles, given to each fragment of the source."""
    docs = lexical.documents(_scoped(index.sources, allowed), "source_key", text.tokens(text.normalize(F.col("title"))))
    hits = lexical.bm25(index.narrowed(docs, words), words, few=True).withColumnRenamed("id", "source_key")
    return hits.join(index.fragments.select("source_key", "fragment_id"), "source_key").select("query_id", F.col("fragment_id").alias("id"), "score")


def screen(candidates: DataFrame, make: Callable[[], models.Model] = models.Extractive, *also: str) -> DataFrame:
    """Candidates (query_id, query, id, text, and columns that stay) with summary and relevance by a model; what it can't parse or finds not applicable goes."""
    prompt = F.to_json(F.struct(F.col("query").alias("question"), "text"))
    reply = models.complete(candidates.withColumn("prompt", prompt), "prompt", make)
    made = reply.withColumn("parsed", _reply(F.col("response.content")))
    good = made.where("response.error IS NULL AND parsed IS NOT NULL AND trim(parsed.summary) <> ''").where(~F.contains(F.upper("parsed.summary"), F.lit("NOT_APPLICABLE")))
    return good.select("query_id", "query", "id", *also, F.col("parsed.summary").alias("summary"), text.coerce_relevance(F.col("parsed.score")).alias("relevance"), (F.col("response.prompt_tokens") + F.col("response.completion_tokens")).alias("tokens"))


# Names under which models put a score or a summary.
SCORE_KEYS = ("relevance_score", "relevance", "score", "相关性评分", "评分")
SUMMARY_KEYS = ("summary", "摘要", "text")


def _read(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for c in contents:
        found = structure.json_object(c)
        if found is None:
            rows.append((None, None))
            continue
        low = {str(k).lower(): v for k, v in found.items()}
        score = next((low[k] for k in SCORE_KEYS if k in low), next((v for v in found.values() if isinstance(v, int | float) and v > 0), None))
        summary = next((found[k] for k in SUMMARY_KEYS if isinstance(found.get(k), str) and found[k].strip()), max((v for v in found.values() if isinstance(v, str)), key=len, default=""))
        rows.append((summary.strip(), None if score is None or isinstance(score, bool) else str(score)))
    return pd.DataFrame(rows, columns=["summary", "score"])


def _reply(content: Column) -> Column:
    made = F.pandas_udf(_read, "struct<summary:string,score:string>")(content)
    return F.when(made["summary"].isNotNull(), made)


def presummarised(candidates: DataFrame, n: int, least: int, make: Callable[[], models.Model] = models.Extractive) -> DataFrame:
    """The cheap way to screen: the n best by rank go to the model for a summary only; relevance comes from the rank.

    A reply that can't be read doesn't lose its candidate, whose text then stands for a summary.
    """
    w = dense.Window.partitionBy("query_id")
    ranked = candidates.withColumn("rank", F.row_number().over(w.orderBy("rank", "id"))).where(F.col("rank") <= n).withColumn("n", F.count("*").over(w))
    prompt = F.to_json(F.struct(F.col("query").alias("question"), "text"))
    made = models.complete(ranked.withColumn("prompt", prompt), "prompt", make).withColumn("parsed", _reply(F.col("response.content")))
    summary = F.coalesce(F.nullif(F.col("parsed.summary"), F.lit("")), F.substring("text", 1, 300))
    return made.select("query_id", "query", "id", summary.alias("summary"), evidence.rank_relevance(F.col("rank"), F.col("n"), least).alias("relevance"))


def evaluated(index: Index, cases: DataFrame, repeat: int = 1, make: Callable[[], models.Model] = models.Extractive) -> DataFrame:
    """Results of all cases (id, question, ...), each asked `repeat` times, ready for evaluation.summary().

    The cases of a run are one plan; if that fails, each case is asked alone, and those that fail have an error.
    """
    numbered = cases.withColumn("query_id", F.xxhash64("id")).withColumnRenamed("question", "query")
    out = None
    for run in range(max(1, repeat)):
        began = time.monotonic()
        asked = lambda some: [(*r, None) for r in ask(index, some, make).select("query_id", "text", "citations", "refused").collect()]
        try:
            answers = asked(numbered.select("query_id", "query"))
        except Exception:  # noqa: BLE001 - looked at case by case
            answers = []
            for row in numbered.select("query_id", "query").collect():
                try:
                    answers += asked(index.spark.createDataFrame([(row.query_id, row["query"])], "query_id long, query string"))
                except Exception as error:  # noqa: BLE001, PERF203 - recorded
                    answers.append((row.query_id, None, None, None, f"{type(error).__name__}: {error}"))
        seconds = time.monotonic() - began
        rows = index.spark.createDataFrame(answers, "q long, answer string, citations string, answer_refused boolean, failed string")
        joined = numbered.join(rows, F.col("query_id") == F.col("q"), "left")
        refused = F.coalesce("answer_refused", F.lit(True))
        answer = F.coalesce("answer", "failed", F.lit(""))
        made = joined.select(
            F.col("id").alias("case_id"), F.lit(run).alias("run_index"), "expected_answerable", refused.alias("refused"), answer.alias("answer"),
            evaluation.keyword_hit(answer, F.col("expected_keywords")).alias("keyword_hit"), evaluation.forbidden_hit(answer, refused, F.col("forbidden_keywords")).alias("forbidden_hit"),
            F.size(F.filter(F.split(F.coalesce("citations", F.lit("")), ","), lambda c: c != "")).cast("long").alias("citation_count"), F.lit(0).cast("long").alias("dangling_citations"),
            F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("tokens"), F.lit(seconds).alias("duration_s"), F.col("failed").alias("error"),
        )
        out = made if out is None else out.unionByName(made)
    return out


def gather(index: Index, questions: DataFrame, found: DataFrame, make: Callable[[], models.Model] = models.Extractive) -> DataFrame:
    """Evidence of the fragments found: key, summary, relevance, citation."""
    s = index.settings
    own = index.fragments.select(F.col("fragment_id").alias("id"), "source_key", "text", "page_start", "page_end")
    # A few fragments for each question are looked up among all: those are not shuffled.
    candidates = index.held(own.join(F.broadcast(found.select("query_id", "id").join(questions, "query_id")), "id"), few=True)
    judged = screen(candidates, make, "source_key", "page_start", "page_end")
    keyed = judged.withColumn("key", identity.evidence_key(F.col("source_key"), F.col("id")))
    stems = index.sources_of(candidates).select("source_key", citations.stem(F.array().cast("array<string>"), F.lit(None).cast("int"), F.col("title")).alias("stem"))
    labelled = keyed.withColumn("label", text.page_label(F.col("page_start"), F.col("page_end")))
    return evidence.screened(evidence.cited(labelled, stems), s.answering.max_evidence, "query_id", s.screening.min_relevance)


def answer(gathered: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, raw, text, citations, refused: the offline answer quotes the summaries with their keys; without evidence it refuses."""
    quote = F.concat("summary", F.lit(" ("), "key", F.lit(")"))
    raw = evidence.context(gathered, quote, "query_id").withColumnRenamed("context", "raw").withColumnRenamed("query_id", "answer_id")
    inline = gathered.select("key", F.regexp_replace("citation", r"^\(|\)$", "").alias("inline")).distinct()
    bound = evidence.bound(raw, inline)
    out = questions.join(bound, F.col("query_id") == F.col("answer_id"), "left")
    return out.select("query_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("keys", F.lit("")).alias("citations"), F.coalesce("refused", F.lit(True)).alias("refused"), F.coalesce("uncited", F.lit(False)).alias("uncited"))


def ask(index: Index, questions: DataFrame, make: Callable[[], models.Model] = models.Extractive) -> DataFrame:
    """The deterministic run: search, gather, answer; one lazily made plan, unless the index is scanned."""
    found = index.held(search(index, questions), few=True)
    return answer(index.held(gather(index, questions, found, make), few=True), questions)


@dataclass
class State:
    """What an agent's run has so far."""

    question: str
    notes: list[str] = field(default_factory=list)
    actions: list[dict] = field(default_factory=list)
    scope: DataFrame | None = None
    found: DataFrame | None = None
    evidence: dict[str, dict] = field(default_factory=dict)
    answer: dict | None = None
    tokens: int = 0
    in_scope: int | None = None

    def line(self, total: int, cost: float = 0.0, currency: str = "USD") -> str:
        """Sources in scope of all, pieces of evidence and cost, for the next prompt of a model."""
        scope = "all" if self.in_scope is None else str(self.in_scope)
        return f"{scope} of {total} sources in scope; {len(self.evidence)} pieces of evidence; spent {cost:.4f} {currency}"


class Agent:
    """Steps chosen by a policy, under limits of steps, time, tokens and steps without new evidence.

    The driver loops over steps; each is a small Spark job. A policy gets the state and returns the name of a
    tool with its arguments, or None to end.
    """

    def __init__(self, index: Index, policy: Callable[[State], tuple[str, dict] | None], make: Callable[[], models.Model] = models.Extractive):
        self.index, self.policy, self.make = index, policy, make
        self.tools = {"search_literature": self.search, "gather_evidence": self.gather, "answer_question": self.respond, "reset_scope": self.reset, "finish": self.finish}

    def _questions(self, state: State, query: str | None = None) -> DataFrame:
        return self.index.spark.createDataFrame([(1, query or state.question)], "query_id long, query string")

    def search(self, state: State, query: str | None = None) -> str:
        found = search(self.index, self._questions(state, query), max(self.index.settings.retrieval.k, 10))
        state.found = found
        sources = found.join(self.index.fragments.select(F.col("fragment_id").alias("id"), "source_key"), "id").groupBy("source_key").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "source_key").limit(10)
        state.scope = sources.select("source_key")
        rows = sources.collect()
        state.in_scope = len(rows)
        return f"{len(rows)} sources, {sum(r.hits for r in rows)} hits"

    def gather(self, state: State, query: str | None = None) -> str:
        asked = self._questions(state, query)
        found = search(self.index, asked, allowed=state.scope)
        rows = gather(self.index, asked, found, self.make).select("key", "summary", "relevance", "citation", "tokens").collect()
        new = [r for r in rows if r.key not in state.evidence]
        state.evidence.update({r.key: r.asDict() for r in new})
        state.tokens += sum(r.tokens for r in rows)
        return f"{len(new)} new pieces of evidence, {len(state.evidence)} in all"

    def respond(self, state: State) -> str:
        limit = self.index.settings.answering.max_evidence
        best = sorted(state.evidence.values(), key=lambda e: (-e["relevance"], e["key"]))[:limit]
        raw = "\n\n".join(f"{e['summary']} ({e['key']})" for e in best)
        inline = {e["key"]: e["citation"].strip("()") for e in best}
        state.answer = {"text": evidence.bind(raw, inline), "refused": not best, "uncited": False}
        return f"answer with {len(best)} citations"

    def reset(self, state: State) -> str:
        state.scope = state.in_scope = None
        return "all sources are in scope"

    def finish(self, state: State, reason: str = "done") -> str:
        state.notes.append(f"finish:{reason}")
        return "finished"

    def run(self, question: str) -> tuple[State, str]:
        """The state at the end and the status of the session."""
        limits, state, began, idle = self.index.settings.agent, State(question), time.monotonic(), 0
        total = self.index.fragments.select("source_key").distinct().count()
        for step in range(limits.max_steps + 1):
            if any(n.startswith("finish:") for n in state.notes):
                break
            if step == limits.max_steps:
                state.notes.append("max_steps_exceeded")
            elif time.monotonic() - began > limits.timeout_s:
                state.notes.append("timeout")
            elif limits.max_tokens is not None and state.tokens > limits.max_tokens:
                state.notes.append("budget_exceeded")
            elif idle >= limits.no_gain_limit:
                state.notes.append("no_new_evidence")
            else:
                chosen = self.policy(state)
                if chosen is None:
                    break
                name, arguments = chosen
                before, started = len(state.evidence), time.monotonic()
                try:
                    seen = self.tools[name](state, **arguments) if name in self.tools else f"unknown tool: {name}"
                except TypeError as error:
                    seen = f"bad arguments: {error}"
                if name == "gather_evidence":
                    idle = idle + 1 if len(state.evidence) == before else 0
                state.actions.append({"step": step, "tool": name, "observation": seen, "status": state.line(total), "seconds": time.monotonic() - started})
                continue
            break
        if state.answer is None:
            self.respond(state)
        answered, refused, uncited = True, state.answer["refused"], state.answer["uncited"]
        row = self.index.spark.createDataFrame([(state.notes, answered, refused, uncited)], "notes array<string>, answered boolean, refused boolean, uncited boolean")
        status = row.select(evidence.status(F.col("notes"), F.col("answered"), F.col("refused"), F.col("uncited"), fallback="SUCCESS").alias("s")).first().s
        return state, status


def deterministic(state: State) -> tuple[str, dict] | None:
    """The fixed policy: search, gather, answer, finish."""
    done = [a["tool"] for a in state.actions]
    for name in ("search_literature", "gather_evidence", "answer_question", "finish"):
        if name not in done:
            return name, {}
    return None
