"""Model responses: parsed, checked and normalised, with the first broken rule as the row's error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, clean_token, fingerprint, once, strip
from ..types import ADOPTION, CANDIDATE, CHALLENGES, CONFIDENCE, CONTEXT, ERRORED, FALSE_FRIEND, LOCATIONS, ACTIVITY_TYPES, STAGE1_PAYLOAD, STAGE2_PAYLOAD, SUCCEEDED, VERDICTS

_MAX_INLINE = 1_000  # names of a closed vocabulary that go into the plan as a literal map

#: Short keys of compact responses.
WIRE1 = {"issue_summary": "s", "issue_activity_type": "t", "issue_challenge_categories": "h", "context_status": "x", "candidates": "c"}
WIRE_CANDIDATE = dict(zip((f.name for f in CANDIDATE), "pelrf", strict=True))
WIRE2 = dict(zip((f.strip().split(" ")[0] for f in STAGE2_PAYLOAD.split(",")), "vmsfeljdbhcao", strict=True))


def unfenced(text: Column) -> Column:
    """The text without a Markdown code fence around it."""
    return strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?is)^```(?:json)?[ \t]*\n(.*?)\n?```$", "$1"))


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return once(unfenced(text), lambda bare: F.when(bare.startswith("{") & F.json_object_keys(bare).isNotNull() & F.from_json(bare, "map<string,string>").isNotNull(), bare))


def schema_errors(text: Column, schema: dict) -> Column:
    """Array of rules of a schema subset (type, properties, required, additionalProperties, enum) that a JSON text breaks."""
    none = F.array().cast("array<string>")

    def check(at: Column, path: str, node: dict) -> Column:
        kind = node.get("type", "string")
        found: list[Column] = []
        wrong = {"object": ~at.startswith("{"), "array": ~at.startswith("["), "boolean": ~at.isin("true", "false"), "string": at.startswith("{") | at.startswith("[")}[kind]
        found.append(F.when(wrong, F.lit(f"{path}: no {kind}")))
        if "enum" in node:
            found.append(F.when(~at.isin(*node["enum"]), F.lit(f"{path}: not allowed")))
        parts = [F.array(*found)]
        if kind == "object":
            def of_keys(keys: Column) -> Column:
                bad = [F.when(~F.array_contains(keys, name), F.lit(f"{path}.{name}: missing")) for name in node.get("required", ())]
                if not node.get("additionalProperties", True):
                    bad.append(F.when(F.size(F.array_except(keys, F.array(*map(F.lit, node.get("properties", {}))))) > 0, F.lit(f"{path}: unknown keys")))
                return F.array(*bad).cast("array<string>")

            parts.append(once(F.coalesce(F.json_object_keys(at), none), of_keys))
            for name, inner in node.get("properties", {}).items():
                if inner.get("type") != "array" or inner.get("items", {}).get("enum"):
                    parts.append(once(F.get_json_object(at, f"$.{name}"), lambda value: F.when(value.isNotNull(), check(value, f"{path}.{name}", inner)).otherwise(none)))  # noqa: B023
        if kind == "array" and node.get("items", {}).get("enum"):
            strange = F.exists(F.from_json(at, "array<string>"), lambda v: ~v.isin(*node["items"]["enum"]))
            parts.append(F.array(F.when(strange, F.lit(f"{path}: item not allowed"))))
        return F.concat(*parts)

    return F.filter(once(text, lambda at: check(at, "$", schema)), lambda x: x.isNotNull())


def outcome(response: Column) -> Column:
    """What a server's JSON answer comes to: struct(text, error, stop_reason, response_id, model, the token counts, rates).

    Answers of both shapes are read: ``candidates`` with a finish reason, and ``choices`` with a message.
    A blocked prompt, a finish other than STOP (``length`` counts as MAX_TOKENS), no choices and a blank
    text are errors; the first that holds is named. A null answer is an error too.
    """
    return once(response, lambda r: once(F.json_object_keys(r), lambda keys: _outcome(r, keys)))


def _outcome(response: Column, keys: Column) -> Column:
    def at(*paths: str) -> Column:
        """The first value; a path whose first key the object lacks isn't searched for."""
        there = lambda p: keys.isNull() | F.array_contains(keys, p.split(".")[0].split("[")[0])
        return F.coalesce(*[F.when(there(p), F.get_json_object(response, f"$.{p}")) for p in paths])

    number = lambda *paths: at(*paths).try_cast("double")
    count = lambda *paths: number(*paths).cast("long")
    usage = {
        "input_tokens": count("usage.prompt_tokens", "usage_metadata.prompt_token_count", "usageMetadata.promptTokenCount"), "output_tokens": count("usage.completion_tokens", "usage_metadata.candidates_token_count", "usageMetadata.candidatesTokenCount"),
        "total_tokens": count("usage.total_tokens", "usage_metadata.total_token_count", "usageMetadata.totalTokenCount"), "thoughts_tokens": count("usage_metadata.thoughts_token_count", "usageMetadata.thoughtsTokenCount"),
        "cached_input_tokens": count("usage.prompt_tokens_details.cached_tokens", "usage_metadata.cached_content_token_count", "usageMetadata.cachedContentTokenCount"),
        "prompt_tokens_per_second": number("timings.prompt_per_second", "timings.prompt_tokens_per_second"), "generation_tokens_per_second": number("timings.predicted_per_second", "timings.generation_tokens_per_second"),
    }
    told = {"response_id": F.coalesce(at("id", "response_id", "responseId"), F.lit("")), "model": F.coalesce(at("model", "model_version", "modelVersion"), F.lit(""))}

    def stop_of(chosen: Column) -> Column:
        own = once(F.lower(F.coalesce(at("choices[0].finish_reason"), F.lit(""))), lambda raw: F.when(raw.isin("", "stop"), "STOP").when(raw.isin("length", "max_tokens"), "MAX_TOKENS").otherwise(F.upper(raw)))
        return F.when(chosen, own).otherwise(F.upper(F.regexp_replace(F.coalesce(at("candidates[0].finish_reason", "candidates[0].finishReason"), F.lit("")), r"^.*\.", "")))

    def text_of(chosen: Column) -> Column:
        parts = F.from_json(at("candidates[0].content.parts"), "array<struct<text: string>>")
        return strip(F.coalesce(F.when(chosen, at("choices[0].message.content")).otherwise(F.coalesce(at("text"), F.array_join(F.transform(parts, lambda p: p["text"]), ""))), F.lit("")))

    def judged(x: Column) -> Column:
        block = at("prompt_feedback.block_reason", "promptFeedback.blockReason")
        error = _first(
            (response.isNull() | keys.isNull(), "no answer"), (block.isNotNull(), "prompt blocked"), (x["chosen"] & at("choices[0]").isNull(), "no choices"),
            (~x["stop"].isin("STOP", ""), "finish is not STOP"), (x["text"] == "", "no text"),
        )
        return once(error, lambda e: F.struct(F.when(e.isNull(), x["text"]).alias("text"), e.alias("error"), x["stop"].alias("stop_reason"), *[v.alias(k) for k, v in (told | usage).items()]))

    return once(at("choices").isNotNull(), lambda chosen: once(F.struct(chosen.alias("chosen"), stop_of(chosen).alias("stop"), text_of(chosen).alias("text")), judged))


def wire_schema(schema: dict, stage: int) -> dict:
    """A response schema with the short keys."""
    def short(node: dict, names: dict[str, str]) -> dict:
        return node | {"properties": {names[k]: v for k, v in node["properties"].items()}, "required": [names[k] for k in node.get("required", ())]}

    out = short(schema, WIRE1 if stage == 1 else WIRE2)
    if stage == 1:
        items = out["properties"]["c"]
        out["properties"] = out["properties"] | {"c": items | {"items": short(items["items"], WIRE_CANDIDATE)}}
    return out


def wire_legend(stage: int) -> str:
    """A line that explains the short keys."""
    told = lambda names: ", ".join(f"{s}={n}" for n, s in names.items())
    return f"Keys: {told(WIRE1)}; within c: {told(WIRE_CANDIDATE)}." if stage == 1 else f"Keys: {told(WIRE2)}."


def encode_wire(value: Column, stage: int, ids: Mapping[str, str] | None = None) -> Column:
    """JSON with short keys of a payload struct, patterns by their ids where ``ids`` (name to id, bounded) has them."""
    table = F.create_map(*[F.lit(x) for p in (ids or {"": ""}).items() for x in p])
    coded = lambda n: F.coalesce(F.try_element_at(table, n), n)
    if stage == 1:
        items = F.transform(value["candidates"], lambda c: F.struct(*[(coded(c[n]) if n == "pattern" else c[n]).alias(s) for n, s in WIRE_CANDIDATE.items()]))
        return F.to_json(F.struct(*[(items if n == "candidates" else value[n]).alias(s) for n, s in WIRE1.items()]))
    special = {"alternative_pattern": lambda x: F.when(x != "", coded(x)).otherwise(x), "overlap_with": lambda x: F.transform(x, coded)}
    return F.to_json(F.struct(*[special.get(n, lambda x: x)(value[n]).alias(s) for n, s in WIRE2.items()]))


def decode_wire(text: Column, stage: int, ids: Mapping[str, str] | None = None, allowed: Column | None = None) -> tuple[Column, Column]:
    """Long-keyed JSON of a compact response, and an error. Payloads without any short key pass as they are.

    ``ids`` (name to id, bounded) gives names back for ids; an id or name that it lacks is an error, as is a
    stage-1 pattern outside ``allowed``, an array of names.
    """
    short = WIRE1 if stage == 1 else WIRE2
    kinds = dict(x.strip().split(" ", 1) for x in STAGE2_PAYLOAD.split(","))
    inner = "array<struct<" + ", ".join(f"{s}: string" for s in WIRE_CANDIDATE.values()) + ">>"
    table = F.create_map(*[F.lit(x) for n, i in (ids or {}).items() for p in ((i, n), (n, n)) for x in p])
    none = F.array().cast("array<string>")
    renamed = lambda c: F.struct(*[c[s].alias(n) for n, s in WIRE_CANDIDATE.items()])

    def read(raw: Column, compact: Column) -> Column:
        """The payload with long keys; without ``ids`` of a compact response only."""
        if stage == 1:
            row = F.from_json(raw, f"s string, t string, h array<string>, x string, c {inner}")
            long = once(row, lambda r: F.struct(*[(F.transform(r["c"], renamed) if n == "candidates" else r[s]).alias(n) for n, s in short.items()]))
        else:
            row = F.from_json(raw, ", ".join(f"{s} {kinds[n]}" for n, s in short.items()))
            long = once(row, lambda r: F.struct(*[r[s].alias(n) for n, s in short.items()]))
        if ids is None:
            return long
        plain = F.from_json(raw, STAGE1_PAYLOAD if stage == 1 else STAGE2_PAYLOAD)
        return F.when(compact, long).otherwise(plain if stage == 2 else once(plain, lambda p: F.struct(*[p[n].alias(n) for n in WIRE1])))

    def swapped(told: Column) -> Column:
        """Names for ids."""
        if stage == 1:
            named = F.transform(told["candidates"], lambda c: F.struct(*[(F.try_element_at(table, c[n]) if n == "pattern" else c[n]).alias(n) for n in WIRE_CANDIDATE]))
            return F.struct(*[(named if n == "candidates" else told[n]).alias(n) for n in WIRE1])
        other = F.when(told["alternative_pattern"] != "", F.try_element_at(table, told["alternative_pattern"])).otherwise(told["alternative_pattern"])
        instead = {"alternative_pattern": other, "overlap_with": F.transform(told["overlap_with"], lambda x: F.try_element_at(table, x))}
        return F.struct(*[instead.get(n, told[n]).alias(n) for n in WIRE2])

    def patterns_wrong(told: Column) -> Column:
        if stage == 1:
            used = F.transform(told["candidates"], lambda c: c["pattern"])
        else:
            used = F.concat(F.filter(F.array(told["alternative_pattern"]), lambda x: x != ""), F.coalesce(told["overlap_with"], none))
        unknown = lambda u: F.when(F.exists(u, lambda x: F.try_element_at(table, x).isNull()), F.lit("pattern unknown"))
        beyond = lambda u: F.when(F.exists(u, lambda x: ~F.array_contains(allowed, F.try_element_at(table, x))), F.lit("pattern outside the shortlist"))
        return once(used, unknown if allowed is None else lambda u: F.coalesce(unknown(u), beyond(u)))

    def flags_wrong(raw: Column) -> Column:
        names = [k for n in ("mechanism_match", "scope_match", "focus_match") for k in (short[n], n)]
        return F.coalesce(*[once(F.get_json_object(raw, f"$.{k}"), lambda f: F.when(f.isNotNull() & ~f.isin("true", "false"), F.lit("a flag is no boolean"))) for k in names])

    def decoded(raw: Column, keys: Column, compact: Column) -> Column:
        whole = (F.size(F.array_except(keys, F.array(*map(F.lit, short.values())))) == 0) & (F.size(keys) == len(short))
        mixed = F.when(compact & ~whole, F.lit("compact response with missing, mixed or unknown keys"))
        errors = [mixed] + ([flags_wrong(raw)] if stage == 2 else [])
        if ids is None:
            return F.struct(F.when(compact & whole, F.to_json(read(raw, compact))).when(~compact, raw).alias("text"), F.coalesce(*errors).alias("error"))
        return once(read(raw, compact), lambda told: F.struct(F.when(whole | ~compact, F.to_json(swapped(told))).alias("text"), F.coalesce(mixed, patterns_wrong(told), *errors[1:]).alias("error")))

    def of_keys(raw: Column, keys: Column) -> Column:
        return once(F.arrays_overlap(keys, F.array(*map(F.lit, short.values()))), lambda compact: decoded(raw, keys, compact))

    both = once(text, lambda raw: once(F.coalesce(F.json_object_keys(raw), none), lambda keys: of_keys(raw, keys)))
    return both["text"], both["error"]


def known_name(value: Column, names: Sequence[str], ascii_only: bool = True) -> Column:
    """Canonical name of a closed vocabulary in the row itself, or null. The vocabulary is bounded and part of the plan."""
    if len(names) > _MAX_INLINE:
        raise ValueError("use operators.vocab for large vocabularies")
    plain = lambda n: " ".join("".join(c if c.isalnum() else " " for c in n.casefold()).split())
    table = F.create_map(*[F.lit(x) for n in dict.fromkeys(names) for x in (plain(n), n)])
    exact = F.create_map(*[F.lit(x) for n in dict.fromkeys(names) for x in (n, n)])
    return F.coalesce(F.try_element_at(exact, value), F.try_element_at(table, fingerprint(value, ascii_only)))


def _each_known(values: Column, names: Sequence[str]) -> Column:
    return F.transform(values, lambda v: known_name(v, names, True))


def _challenges(values: Column, default: bool) -> Column:
    known = F.array_distinct(F.coalesce(_each_known(values, CHALLENGES), F.array().cast("array<string>")))
    told = F.when(F.size(known) > 1, F.filter(known, lambda v: v != "none_explicit")).otherwise(known)
    return F.when(F.size(told) == 0, F.array(F.lit("none_explicit"))).otherwise(told) if default else told


def _first(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in rules])


def normalize_stage1(df: DataFrame, text: str, patterns: Sequence[str]) -> DataFrame:
    """Add ``value`` (struct, null on error) and ``error`` (the first broken rule, null if none) of a stage-1 response."""
    df = df.withColumn("_j", json_object(F.col(text))).withColumn("_p", F.from_json("_j", STAGE1_PAYLOAD))
    p = F.col("_p")
    summary, kind, context = clean_text(p["issue_summary"], True), known_name(p["issue_activity_type"], ACTIVITY_TYPES, True), known_name(p["context_status"], CONTEXT, True)
    item = lambda c: F.struct(known_name(c["pattern"], patterns, True).alias("pattern"), clean_text(c["evidence_text"], True).alias("evidence_text"), known_name(c["evidence_location"], LOCATIONS, True).alias("evidence_location"), clean_text(c["rationale"], True).alias("rationale"), known_name(c["confidence"], CONFIDENCE, True).alias("confidence"))
    all_items = F.transform(F.coalesce(p["candidates"], F.from_json(F.lit("[]"), STAGE1_PAYLOAD.split("candidates ")[1])), item)
    df = df.withColumn("_c", all_items)
    names = F.transform("_c", lambda c: c["pattern"])
    firsts = F.filter("_c", lambda c, i: F.array_position(names, c["pattern"]) == i + 1)
    some = lambda test: F.exists(firsts, test)
    df = df.withColumn("error", _first(
        (p.isNull(), "no JSON object"), (kind.isNull(), "issue_activity_type unknown"), (F.exists(_each_known(p["issue_challenge_categories"], CHALLENGES), lambda v: v.isNull()), "challenge unknown"),
        (context.isNull(), "context_status unknown"), (summary == "", "issue_summary blank"), (F.get_json_object("_j", "$.candidates").isNotNull() & p["candidates"].isNull(), "candidates no list"),
        (F.exists("_c", lambda c: c["pattern"].isNull()), "pattern unknown"), (some(lambda c: c["evidence_text"] == ""), "candidate without evidence_text"), (some(lambda c: c["rationale"] == ""), "candidate without rationale"),
        (some(lambda c: c["evidence_location"].isNull()), "evidence_location unknown"), (some(lambda c: c["confidence"].isNull()), "confidence unknown"),
    ))
    value = F.struct(summary.alias("issue_summary"), kind.alias("issue_activity_type"), _challenges(p["issue_challenge_categories"], True).alias("issue_challenge_categories"), context.alias("context_status"), firsts.alias("candidates"))
    return df.withColumn("value", F.when(F.col("error").isNull(), value)).drop("_j", "_p", "_c")


def downgrade(df: DataFrame) -> DataFrame:
    """A yes without one of its flags becomes uncertain, says so, and takes an adoption status that fits."""
    flags = ("mechanism_match", "scope_match", "focus_match")
    gone = F.concat_ws(", ", *[F.when(~F.coalesce(F.col(f), F.lit(True)), F.lit(f)) for f in flags])
    down = (F.col("verdict") == "yes") & (gone != "")
    note = F.concat(F.lit("[auto-downgraded yes→uncertain: "), gone, F.lit(" ausente] "), F.col("justification"))
    status = F.col("adoption_status")
    return df.withColumns({
        "justification": F.when(down, note).otherwise(F.col("justification")),
        "adoption_status": F.when(down & status.isin("superficial_mention", "not_related"), "conceptual_discussion").otherwise(status),
        "verdict": F.when(down, "uncertain").otherwise(F.col("verdict")),
    })


def normalize_stage2(df: DataFrame, text: str, patterns: Sequence[str]) -> DataFrame:
    """Add ``value`` and ``error`` of a stage-2 response, as for stage 1. Flags that are absent hold."""
    own = df.columns
    df = df.withColumn("_p", F.from_json(json_object(F.col(text)), STAGE2_PAYLOAD))
    p, empty = F.col("_p"), F.array().cast("array<string>")
    alternative = F.when(clean_token(p["alternative_pattern"], True) == "", F.lit("")).otherwise(known_name(p["alternative_pattern"], patterns, True))
    parsed = {
        "verdict": known_name(p["verdict"], VERDICTS, True), **{f: F.coalesce(p[f], F.lit(True)) for f in ("mechanism_match", "scope_match", "focus_match")},
        "evidence_text": clean_text(p["evidence_text"], True), "evidence_location": F.array_distinct(F.coalesce(_each_known(p["evidence_location"], LOCATIONS), empty)), "justification": clean_text(p["justification"], True),
        "adoption_status": known_name(p["adoption_status"], ADOPTION, True), "false_friend_detected": known_name(p["false_friend_detected"], FALSE_FRIEND, True), "pattern_challenge_categories": _challenges(p["pattern_challenge_categories"], False),
        "confidence": known_name(p["confidence"], CONFIDENCE, True), "alternative_pattern": alternative, "overlap_with": F.array_distinct(F.coalesce(_each_known(p["overlap_with"], patterns), empty)),
    }
    strange = F.exists(_each_known(p["pattern_challenge_categories"], CHALLENGES), lambda v: v.isNull())
    inner = df.select(*[F.col(c).alias(f"_own_{c}") for c in own], p.isNull().alias("_bad"), strange.alias("_strange"), *[v.alias(n) for n, v in parsed.items()])
    raw = F.col
    early = _first(
        (raw("_bad"), "no JSON object"), (raw("alternative_pattern").isNull(), "alternative_pattern unknown"), (F.exists("overlap_with", lambda v: v.isNull()), "overlap_with unknown"), (raw("verdict").isNull(), "verdict unknown"),
        (F.exists("evidence_location", lambda v: v.isNull()), "evidence_location unknown"), (raw("adoption_status").isNull(), "adoption_status unknown"), (raw("false_friend_detected").isNull(), "false_friend_detected unknown"),
        (raw("_strange"), "challenge unknown"), (raw("confidence").isNull(), "confidence unknown"), (raw("justification") == "", "justification blank"),
    )
    inner = downgrade(inner.withColumn("_early", early))
    v, s = F.col("verdict"), F.col("adoption_status")
    late = _first(
        ((v == "yes") & s.isin("superficial_mention", "not_related", "insufficient_context"), "yes against adoption_status"), ((v == "no") & ~s.isin("superficial_mention", "not_related"), "no against adoption_status"),
        ((v == "insufficient_context") & (s != "insufficient_context"), "insufficient_context against adoption_status"), ((v == "uncertain") & s.isin("not_related", "superficial_mention"), "uncertain against adoption_status"),
        (v.isin("yes", "uncertain") & (F.col("evidence_text") == ""), "evidence_text blank"), (v.isin("yes", "uncertain") & (F.size("evidence_location") == 0), "evidence_location empty"),
    )
    tags = F.col("pattern_challenge_categories")
    inner = inner.withColumns({"error": F.coalesce("_early", late), "pattern_challenge_categories": F.when(v == "no", empty).when(v.isin("yes", "uncertain") & (F.size(tags) == 0), F.array(F.lit("none_explicit"))).otherwise(tags)})
    return inner.select(*[F.col(f"_own_{c}").alias(c) for c in own], F.when(F.col("error").isNull(), F.struct(*parsed)).alias("value"), "error")


def to_rows(df: DataFrame) -> DataFrame:
    """Results with request_status; errored rows have no payload."""
    return df.withColumn("request_status", F.when(F.col("error").isNull(), SUCCEEDED).otherwise(ERRORED)).withColumn("error", F.coalesce("error", F.lit("")))
