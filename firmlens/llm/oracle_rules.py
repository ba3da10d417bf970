"""SQL counterpart of the quality rules, with the estimation as a recursive query."""

from firmlens.llm.quality_rules import BAD, BASE_FAILED, GOOD, RuleConfig

#: Rounds of the estimation, more than it takes to converge.
ROUNDS = 80


def statement(cfg: RuleConfig | None = None) -> str:
    cfg = cfg or RuleConfig()
    rules = [*BAD, *GOOD]
    start = [(cfg.sound, cfg.false) if r in GOOD else (cfg.false, cfg.sound) for r in rules]
    voted = ", ".join(f"({rule}) AS v_{r}" for r, rule in (BAD | GOOD).items())
    flags = ", ".join(f"v_{r}" for r in rules)
    odds = "ln(share / (1 - share))" + "".join(
        f" + CASE WHEN v_{r} THEN ln(g[{k}] / b[{k}]) ELSE ln((1 - g[{k}]) / (1 - b[{k}])) END"
        for k, r in enumerate(rules, 1)
    )
    new_g = ", ".join(
        f"(sum(CASE WHEN v_{r} THEN n * p ELSE 0 END) + {cfg.prior}e0 * {s[0]}e0) / (sum(n * p) + {cfg.prior}e0)"
        for r, s in zip(rules, start)
    )
    new_b = ", ".join(
        f"(sum(CASE WHEN v_{r} THEN n * (1 - p) ELSE 0 END) + {cfg.prior}e0 * {s[1]}e0) "
        f"/ (sum(n * (1 - p)) + {cfg.prior}e0)"
        for r, s in zip(rules, start)
    )
    old_g, old_b = (", ".join(f"{s[k]}e0" for s in start) for k in (0, 1))
    return rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
placed AS (
  SELECT row, pos,
    [words[pos], words[pos + 1], words[pos + 2], words[pos + 3], words[pos + 4]] AS five
  FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS pos FROM split)),
twice AS (
  SELECT row, pos FROM placed QUALIFY count(*) OVER (PARTITION BY row, five) > 1),
covered AS (
  SELECT row, count(DISTINCT pos + k) AS n_repeat_words
  FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY row),
measured AS (
  SELECT row, doc_id,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS n_marks,
    len(regexp_extract_all(text, '[0-9]')) AS n_digits,
    len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
    len(list_filter(words, lambda w: regexp_matches(w, '[.!?]$'))) AS n_ends,
    len(list_distinct(words)) AS n_distinct,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN covered USING (row)),
voted AS (SELECT *, {voted} FROM measured),
patterns AS (SELECT {flags}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY {flags}),
em AS (
  SELECT 0 AS round, {cfg.share}e0 AS share, [{old_g}] AS g, [{old_b}] AS b
  UNION ALL
  SELECT round + 1, (sum(n * p) + {cfg.prior}e0 * {cfg.share}e0) / (sum(n) + {cfg.prior}e0),
    [{new_g}], [{new_b}]
  FROM (SELECT round, patterns.*, 1 / (1 + exp(-({odds}))) AS p FROM em, patterns)
  WHERE round < {ROUNDS} GROUP BY round),
judged AS (
  SELECT voted.*, {BASE_FAILED} AS base_failed, 1 / (1 + exp(-({odds}))) AS posterior
  FROM voted, em WHERE round = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND posterior >= {cfg.threshold}e0 AS kept
FROM judged
"""
