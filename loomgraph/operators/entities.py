"""Entities of sections, mentions, and parsed model extractions."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import plain
from ..functions.text import estimate_tokens, normalize_type, short_key, trimmed
from ..sources.corpus import merge_ignore
from ..sources.scratch import written
from .ranges import positioned, within_budget

RANGE_FILES = 100_000  # packed in one task
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
TAG = r"(?:^|\s)(#[a-zA-Z][a-zA-Z0-9_-]*)"
PHRASE = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s[A-Z][a-z]+)*(?![A-Za-z0-9_])"


def extract_entities(sections: DataFrame, min_phrase: int = 4) -> DataFrame:
    """(section_key, entity_id, name, type): wikilinks before tags before capitalised phrases,
    one row an entity and section."""

    def found(pattern: str, group: int, kind: str, rank: int):
        each = F.transform(F.regexp_extract_all("text", F.lit(pattern), group), lambda m, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.lit(kind).alias("type"), trimmed(m).alias("name")))
        return F.filter(each, lambda x: F.length(x["name"]) >= min_phrase) if kind == "phrase" else each

    all_ = F.concat(found(WIKILINK, 1, "wikilink", 0), found(TAG, 1, "tag", 1), found(PHRASE, 0, "phrase", 2))
    rows = sections.select(F.col("node_key").alias("section_key"), F.explode(all_).alias("e")).select("section_key", short_key(F.col("e.name")).alias("entity_id"), "e")
    first = F.min(F.struct("e.rank", "e.i", "e.name", "e.type")).alias("m")
    return rows.groupBy("section_key", "entity_id").agg(first).select("section_key", "entity_id", "m.name", "m.type")


def entity_tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ENTITIES, SECTION_ENTITIES): the name and type of the first section in key order hold."""
    first = F.min_by(F.struct("name", "type"), F.col("section_key")).alias("m")
    entities = extracted.groupBy("entity_id").agg(first).select("entity_id", "m.name", "m.type")
    return entities, extracted.select("section_key", "entity_id").distinct()


def parse_extractions(completions: DataFrame, max_entities: int = 30, max_relations: int = 30) -> tuple[DataFrame, DataFrame]:
    """Entities (batch_id, name, type) and relations (batch_id, src, dst, relation) of the lines
    ``ENTITY|name|type`` and ``REL|a|b|relation``; other lines are skipped."""
    lines = completions.select("batch_id", F.posexplode(F.split("completion", "\r?\n")).alias("i", "line"))
    part = lines.select("batch_id", "i", F.split(trimmed(F.col("line")), r"\|").alias("p"))
    field = lambda k, default="": trimmed(F.coalesce(F.nullif(F.get("p", F.lit(k)), F.lit("")), F.lit(default)))
    ent = part.filter("p[0] = 'ENTITY'").select("batch_id", "i", field(1).alias("name"), field(2, "concept").alias("type")).filter("name <> ''")
    ent = ent.groupBy("batch_id", "name").agg(F.min_by("type", "i").alias("type"))
    ent = ent.withColumn("n", F.row_number().over(W.partitionBy("batch_id").orderBy("name"))).filter(F.col("n") <= max_entities).drop("n")
    rel = part.filter("p[0] = 'REL'").select("batch_id", field(1).alias("src"), field(2).alias("dst"), field(3, "related_to").alias("relation"))
    rel = rel.filter("src <> '' AND dst <> '' AND src <> dst").distinct()
    rel = rel.withColumn("n", F.row_number().over(W.partitionBy("batch_id").orderBy("src", "dst", "relation"))).filter(F.col("n") <= max_relations).drop("n")
    return ent, rel


def _haystack():
    return F.lower(F.concat(F.coalesce("heading_path", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))


NEEDLE_CHARS = 8_000_000  # of names searched for in one pass: an automaton of some 200 MB
HITS = 65_536  # that leave a task at a time, about


def match_mentions(names: DataFrame, sections: DataFrame, min_len: int = 4, needle_chars: int = NEEDLE_CHARS, first: int | None = None) -> DataFrame:
    """(name, section_key) of every section that holds a name, in any case; with ``first``, of each
    name only so many, those of the smallest keys, of which a task sends no more. Names of some
    ``needle_chars`` characters go to every task as one automaton, and each text is read where it
    lies; more names than that take a pass over the texts for each such part. Nothing of the texts
    is shuffled, and without ``first`` no hits are either, if the keys of the sections differ."""
    found = _matched(names.select("name", F.col("name").alias("value")), sections, min_len, needle_chars, first)
    return _first_sections(found.select(F.col("value").alias("name"), "section_key"), first)


def _matched(names: DataFrame, sections: DataFrame, min_len: int = 4, needle_chars: int = NEEDLE_CHARS, first: int | None = None) -> DataFrame:
    """(value, section_key), once a row of ``sections``, of the ``names`` (name, value) that it holds."""
    needles = names.select(F.lower(trimmed(F.col("name"))).alias("needle"), "value").filter(F.length("needle") >= min_len).groupBy("needle").agg(F.sort_array(F.collect_set("value")).alias("values"))
    needles = written(needles, "needles")
    hay = sections.select(F.col("node_key").alias("section_key"), _haystack().alias("hay")).filter(F.length("hay") >= min_len)
    parts = max(1, -(-(needles.agg(F.sum(F.length("needle"))).first()[0] or 0) // needle_chars))
    found = None
    for k in range(parts):
        mine = needles.filter(F.pmod(F.xxhash64("needle"), F.lit(parts)) == k) if parts > 1 else needles
        hits = _hits(hay, mine, first)
        found = hits if found is None else found.unionByName(hits)
    return found


def _hits(hay: DataFrame, needles: DataFrame, first: int | None) -> DataFrame:
    table = needles.toArrow().combine_chunks()
    shared = hay.sparkSession.sparkContext.broadcast((table["needle"].combine_chunks(), table["values"].combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words, values = shared.value
        ends, flat = values.offsets.to_numpy().astype(np.int64), values.values
        codes = flat.dictionary_encode()
        same = np.unique(codes.indices.to_numpy(), return_index=True)[1][codes.indices.to_numpy()]  # the first place of each value
        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(word.as_py(), k)
        automaton.make_automaton()

        def sent(keys: list[str], ks: list[list[int]]) -> pa.RecordBatch:
            of = np.concatenate([np.asarray(k, np.int64) for k in ks])
            counts = ends[of + 1] - ends[of]
            at = np.repeat(ends[of], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            owner = np.repeat(np.repeat(np.arange(len(ks)), [len(k) for k in ks]), counts)
            pair = np.unique(owner * len(flat) + same[at])  # a value may stand for several words
            return pa.RecordBatch.from_arrays([flat.take(pa.array(pair % len(flat))), pa.array(keys, pa.string()).take(pa.array(pair // len(flat)))], ["value", "section_key"])

        least: dict[int, list[str]] = {}
        keys, ks, n = [], [], 0
        for b in batches if len(words) else ():
            for key, text in zip(b.column("section_key").to_pylist(), b.column("hay").to_pylist(), strict=True):
                met = {k for _, k in automaton.iter(text)}
                if first is None:
                    if met:
                        keys.append(key)
                        ks.append(list(met))
                        n += len(met)
                    if n > HITS:
                        yield sent(keys, ks)
                        keys, ks, n = [], [], 0
                    continue
                for k in met:
                    kept = least.setdefault(k, [])
                    if (len(kept) < first or key < kept[-1]) and key not in kept:
                        insort(kept, key)
                        del kept[first:]
        for k, kept in least.items():
            for key in kept:
                keys.append(key)
                ks.append([k])
            if len(keys) > HITS:
                yield sent(keys, ks)
                keys, ks = [], []
        if keys:
            yield sent(keys, ks)

    return hay.mapInArrow(run, "value string, section_key string")


def _first_sections(mentions: DataFrame, first: int | None) -> DataFrame:
    if first is None:
        return mentions
    place = F.row_number().over(W.partitionBy("name").orderBy("section_key"))
    return mentions.distinct().withColumn("n", place).filter(F.col("n") <= first).drop("n")


def _names(parsed: tuple[DataFrame, DataFrame]) -> DataFrame:
    entities, relations = parsed
    ends = relations.select(F.col("src").alias("name")).unionByName(relations.select(F.col("dst").alias("name")))
    return entities.select("name").unionByName(ends).distinct()


def first_mentions(parsed: tuple[DataFrame, DataFrame], sections: DataFrame, first: int) -> DataFrame:
    """(name, section_key) as ``ground_extractions`` has them, of each name the first sections only:
    what semantic edges of at most ``first`` - 1 a relation can depend on."""
    return match_mentions(_names(parsed), sections, first=first)


def ground_extractions(parsed: tuple[DataFrame, DataFrame], sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, section_entities, mentions by name): names met in no section are dropped;
    relation ends may be grounded without an entity line. Each is made from the texts when it is
    read: a section's rows come from the task that holds it, and are not shuffled."""
    names = parsed[0].select("name").distinct()
    pairs = _matched(names.select("name", short_key(F.col("name")).alias("value")), sections)
    return ground_entities(parsed, sections), pairs.select("section_key", F.col("value").alias("entity_id")), match_mentions(_names(parsed), sections)


def ground_entities(parsed: tuple[DataFrame, DataFrame], sections: DataFrame) -> DataFrame:
    """The entities of ``ground_extractions`` alone. A name needs one section to stay, so a task
    sends no more of it, and the pairs of names and sections are never made."""
    return _one_each(_met(parsed[0], match_mentions(parsed[0].select("name").distinct(), sections, first=1)))


def _met(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, type) of the entities met."""
    kinds = entities.groupBy("name").agg(F.min_by("type", "batch_id").alias("type"))
    return mentions.select("name").distinct().join(kinds, "name")


def _one_each(kept: DataFrame) -> DataFrame:
    rows = kept.select(short_key(F.col("name")).alias("entity_id"), "name", F.concat(F.lit("llm:"), normalize_type(F.col("type"))).alias("type"))
    return rows.groupBy("entity_id").agg(F.min(F.struct("name", "type")).alias("m")).select("entity_id", "m.name", "m.type")  # names that differ by case


def refresh_mentions(entities: DataFrame, changed: DataFrame, existing: DataFrame) -> DataFrame:
    """``existing`` (section_key, entity_id) plus the stored model entities met in changed sections."""
    known = entities.filter(F.col("type").startswith("llm:"))
    met = _matched(known.select("name", F.col("entity_id").alias("value")), changed).select("section_key", F.col("value").alias("entity_id"))
    return merge_ignore(existing, met, ["section_key", "entity_id"])


def sections_for_entities(mentions: DataFrame, entity_ids: DataFrame) -> DataFrame:
    return mentions.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi").select("section_key", "entity_id")


def extraction_batches(sections: DataFrame, cap_tokens: int = 3000, blocks: int | None = None) -> DataFrame:
    """(file_id, batch_id, tokens): each file's sections within the cap, files packed in id order
    until the next would not fit (an oversize file stands alone).

    Next-fit is exact over any number of ranges of files. All that a range needs to know of those
    before it is how full their last batch is, so each range first says how full its own will be
    for every such number: a step function with one step a file that the open batch may still
    take. These are followed from range to range, and each range is then packed by itself, with
    the number of batches before it. ``blocks`` is the number of ranges (about ``RANGE_FILES``
    files each if it is not given); the driver sees one step function and two numbers a range."""
    texts = sections.filter("trim(text) <> ''").withColumn("tok", estimate_tokens(trimmed(F.col("text"))))
    files = within_budget(texts, "file_id", "node_key", "tok", cap_tokens).groupBy("file_id").agg(F.sum("tok").alias("tokens"))
    return next_fit(files, cap_tokens, blocks)


def packed(tokens: list[int], cap: int, held: int) -> tuple[list[int], int]:
    """Next-fit: the batch of each file (0: the one that ``held`` tokens are in already) and how full
    the last one is. More than ``cap`` counts as ``cap``, as nothing fits either way."""
    batch, out = 0, []
    for t in tokens:
        if held and held + t > cap:
            batch, held = batch + 1, 0
        held = min(cap, held + t)
        out.append(batch)
    return out, held


def fill_steps(tokens: list[int], cap: int) -> list[tuple[int, int | None, int]]:
    """(least held, held after, batches opened) of a range, as a step function of what the last
    batch holds at its start: one step for each place at which that batch may end."""
    after: list[tuple[int, int]] = [(0, 0)] * (len(tokens) + 1)  # batches opened and held, if one begins at a file
    total = [0, *accumulate(tokens)]
    for i in range(len(tokens) - 1, -1, -1):
        j = max(i + 1, bisect_right(total, total[i] + cap) - 1)
        after[i] = (0, min(cap, total[-1] - total[i])) if j >= len(tokens) else (after[j][0] + 1, after[j][1])
    steps = [(0, after[0][1], after[0][0])]
    for i, t in enumerate(tokens):  # the open batch takes files 0 to i - 1
        if total[i] >= cap:
            return steps
        if t:
            steps.append((max(1, cap - total[i + 1] + 1), after[i][1], after[i][0] + 1))
    return [*steps, (1, None, 0)] if total[-1] < cap else steps  # it may take all of them


def next_fit(files: DataFrame, cap: int, ranges: int | None = None) -> DataFrame:
    """(file_id, batch_id, tokens) from ``files`` (file_id, tokens): see ``extraction_batches``."""
    placed, n = positioned(files.select("file_id", F.col("tokens").cast("long").alias("tokens")), ["file_id"], "files")
    size = max(1, -(-n // (ranges or max(1, -(-n // RANGE_FILES)))))
    dealt = placed.withColumn("part", F.expr(f"pos div {size}"))

    def ahead(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = rows.sort_values("pos")["tokens"].tolist()
        steps = fill_steps(tokens, cap)
        return pd.DataFrame({"part": int(rows["part"].iloc[0]), "least": [s[0] for s in steps], "after": [-1 if s[1] is None else s[1] for s in steps], "opened": [s[2] for s in steps], "total": sum(tokens)})

    found: dict[int, list] = {}
    for r in dealt.groupBy("part").applyInPandas(ahead, "part long, least long, after long, opened long, total long").collect():
        found.setdefault(r["part"], []).append(r)
    held, number, entry = 0, 0, {}
    for part in sorted(found):
        entry[part] = (held, number)
        step = max((r for r in found[part] if r["least"] <= held), key=lambda r: r["least"])
        number += step["opened"]
        held = min(cap, held + step["total"]) if step["after"] < 0 else step["after"]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = plain(rows).sort_values("pos")
        before, first = entry[int(rows["part"].iloc[0])]
        batch, _ = packed(rows["tokens"].tolist(), cap, before)
        return pd.DataFrame({"file_id": rows["file_id"], "batch_id": [f"000000-{first + b:08d}" for b in batch], "tokens": rows["tokens"]})

    return dealt.groupBy("part").applyInPandas(pack, "file_id string, batch_id string, tokens long")


def offline_completion(prompts: list[str]) -> list[str]:
    """The model stand-in: the first line that is not blank, cut to 200 characters."""
    return [next((x.strip()[:200] for x in (p or "").splitlines() if x.strip()), "") for p in prompts]


def run_completions(prompts: DataFrame, complete_fn=offline_completion, batch: int = 64) -> DataFrame:
    """``prompts`` (with column prompt) plus ``completion`` and ``error``: a failing call leaves an
    empty completion and its reason; the others of its batch are tried one by one."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", completion string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done: list[str] = []
            errors: list[str | None] = []
            texts = b["prompt"].tolist()
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    done += complete_fn(part)
                    errors += [None] * len(part)
                except Exception:  # noqa: BLE001 - any failure of the injected function
                    for one in part:
                        try:
                            done += complete_fn([one])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            done.append("")
                            errors.append(str(e)[:200])
            yield plain(b).assign(completion=done, error=errors)

    return prompts.mapInPandas(run, fields)
