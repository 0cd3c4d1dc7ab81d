"""The library in one object: a configuration becomes a dictionary that rewrites columns and guards calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import audit, policy, redaction, terms
from veilframe.sources.config import Config, check_packs, pack_usage, parse_config


class Redactor:
    """Redactor(spark, config, seed): config a Config or its JSON text; packs maps a pack's name to its terms."""

    def __init__(self, spark: SparkSession, config: Config | str, seed: str, packs: dict[str, list[str]] | None = None):
        self.spark, self.config = spark, parse_config(config) if isinstance(config, str) else config
        check_packs(self.config, packs or {})
        refs = terms.term_refs(spark, self.config, packs)
        self.skipped = terms.term_counts(refs).first()["skipped"]
        self.dimension = terms.resolve_terms(refs)
        self.dictionary = terms.compile_dictionary(self.dimension, seed, self.config.placeholder)

    def find(self, text: Column | str) -> Column:
        return redaction.find_terms(self.spark, self.dictionary, text)

    def has_term(self, text: Column | str) -> Column:
        return redaction.has_term(self.dictionary, text)

    def redact(self, text: Column | str, *, allow_drop: bool = True) -> Column:
        return redaction.redact(self.spark, self.dictionary, text, allow_drop=allow_drop)

    def redact_json(self, payload: Column | str) -> Column:
        return redaction.redact_json(self.spark, self.dictionary, payload)

    def guard(self, tool: Column | str, payload: Column | str, config_path: str = "") -> Column:
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        return policy.guard_calls(self.spark, self.dictionary, as_col(tool), as_col(payload), config_path)

    def hits(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return redaction.term_hits(docs, self.dictionary, key=key, text=text)

    def log(self, passes: DataFrame) -> DataFrame:
        """Entries with list names from passes that redact() gave."""
        return audit.named_hits(audit.hit_rows(passes), self.dimension.select("folded", "canonical", "list_name"))

    def register(self) -> None:
        redaction.register_functions(self.spark, self.dictionary)

    def status(self, paused: bool = False) -> str:
        return policy.status(True, paused, None, len(self.dictionary.terms))

    def packs(self, found: DataFrame) -> DataFrame:
        """Every pack and the lists that use it; names asked for that are no pack are there too."""
        lists = self.spark.createDataFrame([(x.pack, x.name) for x in self.config.lists if x.pack], "pack string, list_name string")
        return pack_usage(lists, found.select("pack").distinct())

    def command(self, line: str, *, entries: DataFrame | None = None, packs: DataFrame | None = None, state: dict | None = None) -> list[str]:
        """The lines that a command answers: on, off, status, packs, log, log clear, reload.

        state holds `paused`, `cleared` (the seq after which passing entries count) and `reload`; the caller keeps it between commands.
        """
        state = {} if state is None else state
        words = line.split()
        if words in (["on"], ["off"]):
            state["paused"] = words == ["off"]
        elif words == ["log", "clear"]:
            last = entries.agg(F.max("seq")).first()[0] if entries is not None else None
            state["cleared"] = last if last is not None else state.get("cleared")
            return ["cleared; what stands in every request stays"]
        elif words == ["log"]:
            rows = entries.where((F.col("mode") == "standing") | (F.col("seq") > F.lit(state.get("cleared", -1))))
            kept = audit.newest_sources(rows)
            return audit.log_text(audit.log_lines(kept), audit.forgotten(rows).first()[0])
        elif words == ["packs"]:
            return [f"{r['pack']}: {', '.join(r['used_by']) or 'not used'}{'' if r['found'] else ' (NOT FOUND)'}" for r in self.packs(packs).orderBy("pack").collect()]
        elif words == ["reload"]:
            state["reload"] = True
        elif words != ["status"]:
            return ["commands: on, off, status, packs, log, log clear, reload"]
        return [self.status(state.get("paused", False))]
