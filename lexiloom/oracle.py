"""The core's queries in SQL, written for DuckDB and independent of the DataFrame plans.

Learners are unrolled to one materialized table of splits, counts and best pair for each merge; longest matches walk
along the words in a recursive query; merge replay is a nest of replacements.
"""

from __future__ import annotations

from lexiloom.catalog import MERGES, NAIVE_MERGES, STEPS, bpe_vocab_list, naive_vocab_list, wp_vocab_list

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORDS = r"regexp_extract_all(lower({}), '[a-z]+(?:''[a-z]+)?')"

TOKENS = f"""tok AS MATERIALIZED (SELECT doc_id, (i - 1)::INT AS pos, w[i] AS word
  FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), unnest(range(1, len(w) + 1)) AS t(i)),
types AS MATERIALIZED (SELECT word, count(*) AS freq, min(struct_pack(d := doc_id, p := pos)) AS seen FROM tok GROUP BY word)"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _list(values: list[str]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _split(kind: str, word: str = "word") -> str:
    bars = rf"regexp_replace({word}, '(.)', '|\1|', 'g')"
    if kind == "wp":
        return rf"'|' || {word}[1] || '|' || regexp_replace(substr({word}, 2), '(.)', '|##\1|', 'g')"
    return bars if kind == "naive" else f"{bars} || '|_|'"


TOKS = "list_filter(string_split(sp, '|'), lambda x: x <> '')"
PAIRS = f"(SELECT toks[i] AS a, toks[i + 1] AS b, i, freq, seen FROM (SELECT freq, seen, {TOKS} AS toks FROM {{}}), unnest(range(1, len(toks))) AS t(i))"
SYMBOLS = f"(SELECT unnest({TOKS}) AS tok, freq FROM {{}})"


def _learner(kind: str, first_seen: bool, least: int = 1) -> str:
    """Tables s0.., b0..: the splits before and the best pair of each merge."""
    parts = [TOKENS, f"s0 AS MATERIALIZED (SELECT word, freq, seen, {_split(kind)} AS sp FROM types)"]
    merged = "a || CASE WHEN starts_with(b, '##') THEN substr(b, 3) ELSE b END"
    for k in range(STEPS):
        tie = "min(struct_pack(w := seen, i := i))" if first_seen else "min(struct_pack(a := a, b := b))"
        counts = f"SELECT a, b, sum(freq)::BIGINT AS n, {tie} AS tie FROM {PAIRS.format(f's{k}')} GROUP BY a, b"
        score = "n"
        if kind == "wp":
            parts.append(f"f{k} AS MATERIALIZED (SELECT tok, sum(freq)::BIGINT AS f FROM {SYMBOLS.format(f's{k}')} GROUP BY tok)")
            counts = f"SELECT a, b, n::DOUBLE / (x.f::DOUBLE * y.f::DOUBLE) AS n, tie FROM ({counts}) JOIN f{k} x ON x.tok = a JOIN f{k} y ON y.tok = b WHERE n >= {least}"
        parts.append(f"b{k} AS MATERIALIZED (SELECT a, b, {merged} AS m FROM ({counts}) ORDER BY {score} DESC, tie LIMIT 1)")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT word, freq, seen, replace(sp, '|' || a || '||' || b || '|', '|' || m || '|') AS sp FROM s{k}, b{k})")
    return "WITH " + ",\n".join(parts)


BESTS = " UNION ALL ".join(f"SELECT {k} AS rank, a, b, m AS merged FROM b{k}" for k in range(STEPS))


def _replay(word: str, merges: list[tuple[str, str]], end: str) -> str:
    """The split of a word after all merges; q is unknown."""
    sql = rf"replace(regexp_replace({word}, '(.)', '|\1|', 'g'), '|q|', '|<unk>|') || '{f'|{end}|' if end else ''}'"
    for a, b in merges:
        sql = f"replace({sql}, {_text(f'|{a}||{b}|')}, {_text(f'|{a}{b}|')})"
    return sql


def _bpe(name: str, source: str, merges=MERGES, end: str = "_") -> str:
    return f"{name} AS MATERIALIZED (SELECT word, list_filter(string_split({_replay('word', merges, end)}, '|'), lambda x: x <> '') AS pieces FROM (SELECT DISTINCT word FROM {source}))"


def _longest(name: str, source: str, vocab: list[str], end: str = "_") -> str:
    return f"""{name}_v(v) AS MATERIALIZED (VALUES {_list(vocab)}),
{name}_w AS (SELECT word, word || '{end}' AS ws, 1 AS pos, []::VARCHAR[] AS pieces FROM (SELECT DISTINCT word FROM {source})
  UNION ALL SELECT word, ws, pos + coalesce(max(len(v)), 1), list_append(pieces, coalesce(arg_max(v, len(v)), '<unk>'))
  FROM {name}_w LEFT JOIN {name}_v ON starts_with(substr(ws, pos), v) WHERE pos <= len(ws) GROUP BY word, ws, pos, pieces),
{name} AS MATERIALIZED (SELECT word, pieces FROM {name}_w WHERE pos > len(ws))"""


def _wordpiece(name: str, source: str) -> str:
    vocab = [v for v in wp_vocab_list() if v[0] != "["]
    return f"""{name}_v(v) AS MATERIALIZED (VALUES {_list(vocab)}),
{name}_w AS (SELECT word, lower(word) AS ws, 1 AS pos, []::VARCHAR[] AS pieces FROM (SELECT DISTINCT word FROM {source})
  UNION ALL SELECT word, ws, CASE WHEN count(v) = 0 THEN len(ws) + 1 ELSE pos + max(len(v)) - CASE WHEN pos > 1 THEN 2 ELSE 0 END END,
  CASE WHEN count(v) = 0 THEN ['[UNK]'] ELSE list_append(pieces, arg_max(v, len(v))) END
  FROM {name}_w LEFT JOIN {name}_v ON starts_with(CASE WHEN pos > 1 THEN '##' || substr(ws, pos) ELSE ws END, v) AND (pos > 1 OR NOT starts_with(v, '##'))
  WHERE pos <= len(ws) GROUP BY word, ws, pos, pieces),
{name} AS MATERIALIZED (SELECT word, pieces FROM {name}_w WHERE pos > len(ws))"""


def _plain(p: str) -> str:
    return f"list_transform(list_filter({p}, lambda x: x <> '_'), lambda x: replace(replace(x, '_', ''), '##', ''))"


def _bpe_surfaces(name: str, source: str) -> str:
    """Pieces without markers of the parts of each word of ``source``."""
    return f"""{name}_p AS MATERIALIZED (SELECT word AS whole, i, p[i] AS word FROM (SELECT word, {WORDS.format("word")} AS p FROM (SELECT DISTINCT word FROM {source})), unnest(range(1, len(p) + 1)) AS t(i)),
{_bpe(f"{name}_s", f"{name}_p")},
{name}_c AS (SELECT whole, flatten(list({_plain("pieces")} ORDER BY i)) AS pieces FROM {name}_p JOIN {name}_s USING (word) GROUP BY whole),
{name} AS MATERIALIZED (SELECT word, coalesce(pieces, []::VARCHAR[]) AS pieces FROM (SELECT DISTINCT word FROM {source}) LEFT JOIN {name}_c ON whole = word)"""


def _wp_surfaces(name: str, source: str) -> str:
    return f"{_wordpiece(f'{name}_s', source)},\n{name} AS MATERIALIZED (SELECT word, {_plain('pieces')} AS pieces FROM {name}_s)"


def _vec(p: str, word: str = "word") -> str:
    ends = f"list_transform(range(1, len({p})), lambda k: list_sum(list_transform({p}[1:k], lambda x: len(x))))"
    return f"list_transform(range(1, len({word})), lambda i: CASE WHEN list_contains({ends}, i) THEN 1 ELSE 0 END)"


GOLD = r"""gold AS MATERIALIZED (SELECT word, arg_max(surfaces, line_no) AS surfaces FROM (SELECT word, line_no,
  list_filter(list_transform(string_split_regex(split_part(analyses, ',', 1), '\s+'), lambda x: split_part(x, ':', 1)), lambda x: x <> '' AND NOT starts_with(x, '+') AND NOT starts_with(x, '~')) AS surfaces
  FROM gold_segmentation WHERE word <> '') WHERE len(surfaces) > 0 GROUP BY word)"""

RANKED = """ranked AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY freq DESC, word) - 1)::INT AS rank, word FROM types ORDER BY freq DESC, word LIMIT 10000)"""

LINES = r"""lines AS (SELECT 'wiki' AS domain, text FROM wiki_test UNION ALL SELECT 'guten', line FROM guten_test),
fert AS MATERIALIZED (SELECT domain, word, count(*) AS c FROM (SELECT domain, unnest(list_filter(string_split_regex(text, '[^\pL\pN_]+'), lambda x: x <> '')) AS word FROM lines) GROUP BY domain, word)"""

# The engine's own word bounds are of ASCII alone: letters and digits beyond it become a 0, which bounds a word as they do.
RARE = rf"""plain AS (SELECT doc_id, {_strip("lower(text)")} AS t FROM documents),
ascii AS MATERIALIZED (SELECT doc_id, CASE WHEN length(t) = strlen(t) THEN t ELSE array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN ord(c) > 127 AND regexp_full_match(c, '[\pL\pN]') THEN '0' ELSE c END), '') END AS t FROM plain),
rare_tok AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, regexp_extract_all(t, '\b[a-z''-]+\b') AS w FROM ascii), unnest(range(1, len(w) + 1)) AS t(i)),
rare AS MATERIALIZED (SELECT word, count(*) AS freq, min(struct_pack(d := doc_id, p := i)) AS seen FROM rare_tok GROUP BY word)"""
LEAST = f"{RARE}, least AS MATERIALIZED (SELECT word FROM rare ORDER BY freq, seen DESC LIMIT 1000)"


def _counts(a: str, b: str) -> str:
    """Per word: pieces, length, boundaries of both sides and common ones, and the word's F1."""
    return f"""vecs AS (SELECT a.word, a.pieces AS pa, b.pieces AS pb, {_vec('a.pieces', 'a.word')} AS x, {_vec('b.pieces', 'a.word')} AS y FROM {a} a JOIN {b} b USING (word)),
cnt AS MATERIALIZED (SELECT word, len(pa) AS na, len(pb) AS nb, len(x) AS n, coalesce(list_sum(x), 0)::BIGINT AS sx, coalesce(list_sum(y), 0)::BIGINT AS sy,
  coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda k: x[k] * y[k])), 0)::BIGINT AS i FROM vecs),
per AS MATERIALIZED (SELECT *, CASE WHEN sx + sy > 0 THEN (2 * i)::DOUBLE / (sx + sy) ELSE 0 END AS f1,
  CASE WHEN sx > 0 AND sx < n AND sy > 0 AND sy < n THEN 1 - ((sx + sy - 2 * i) * n)::DOUBLE / ((n - sx) * sy + sx * (n - sy))::DOUBLE WHEN sx = sy AND sx = i THEN 1 ELSE 0 END AS k FROM cnt)"""


def _ratio(x: str, y: str) -> str:
    return f"CASE WHEN {y} > 0 THEN ({x})::DOUBLE / ({y})::DOUBLE ELSE 0.0 END"


GOLD_ROW = f"SELECT {_ratio('sum(i)', 'sum(sy)')} AS precision, {_ratio('sum(i)', 'sum(sx)')} AS recall, {_ratio('2 * sum(i)', 'sum(sx) + sum(sy)')} AS f1, {_ratio('sum(nb)', 'count(*)')} AS avg_spw_pred, {_ratio('sum(na)', 'count(*)')} AS avg_spw_gold, round(avg(f1), 9) AS per_word_f1 FROM per"
FREQ_ROW = f"SELECT {_ratio('sum(len(pieces)) FILTER (rank < 1000)', 'count(*) FILTER (rank < 1000)')} AS avg_fertility_1k, {_ratio('sum(len(pieces))', 'count(*)')} AS avg_fertility_10k, count(DISTINCT word) FILTER (rank < 1000 AND len(pieces) = 1) AS n_preserved_1k, count(DISTINCT word) FILTER (len(pieces) = 1) AS n_preserved_10k FROM ranked JOIN fs USING (word)"
DOMAIN_ROWS = f"SELECT domain, sum(c)::BIGINT AS n_words, sum(c * len(pieces))::BIGINT AS n_pieces, {_ratio('sum(c * len(pieces))', 'sum(c)')} AS fertility FROM fert JOIN ds USING (word) GROUP BY domain"
JOINED = "word, array_to_string(pieces, ' ') AS pieces"


def _rates(n: str, total: str, f: str, both: bool = True) -> str:
    unknown = "(len(pieces) = 1 AND pieces[1] = '[UNK]')::INT"
    one = "(len(pieces) = 1)::INT"
    single = f"{_ratio(f'sum({f} * {one})', total)} AS single_rate, " if both else ""
    return f"({total})::BIGINT AS {n}, sum({f} * len(pieces))::BIGINT AS n_pieces, {_ratio(f'sum({f} * len(pieces))', total)} AS avg_pieces, {_ratio(f'sum({f} * {unknown})', total)} AS unk_rate, {single}{_ratio(f'sum({f} * ({one} - {unknown}))', total)} AS single_known_rate"


def _wordpiece_lists(name: str, source: str) -> str:
    """The same greedy match written otherwise: for each place the longest token by a join on substrings, then a fold
    over the places."""
    vocab = [v for v in wp_vocab_list() if v[0] != "["]
    return f"""{name}_v(v) AS MATERIALIZED (VALUES {_list(vocab)}),
{name}_s AS (SELECT word, i, n FROM (SELECT DISTINCT word FROM {source}), unnest(range(1, len(word) + 1)) AS a(i), unnest(range(1, 8)) AS b(n) WHERE i + n <= len(word) + 1),
{name}_m AS (SELECT word, i, max(n) AS n FROM {name}_s JOIN {name}_v ON v = CASE WHEN i > 1 THEN '##' ELSE '' END || substr(word, i, n) GROUP BY word, i),
{name}_l AS (SELECT word, map_from_entries(list((i, n))) AS m FROM {name}_m GROUP BY word),
{name}_f AS (SELECT word, list_reduce(list_prepend([1], list_transform(range(1, len(word) + 1), lambda i: [i])), lambda acc, x: CASE WHEN acc[-1] = x[1] THEN list_append(acc, x[1] + coalesce(m[x[1]], 100000)) ELSE acc END) AS ends FROM (SELECT DISTINCT word FROM {source}) LEFT JOIN {name}_l USING (word)),
{name} AS MATERIALIZED (SELECT word, CASE WHEN ends[-1] <> len(word) + 1 THEN ['[UNK]'] ELSE list_transform(range(1, len(ends)), lambda k: CASE WHEN k > 1 THEN '##' ELSE '' END || word[ends[k]:ends[k + 1] - 1]) END AS pieces FROM {name}_f)"""


# The most frequent 2,000 words, a vocabulary of 1,000 tokens learned from them step by step, and their pieces by merge
# replay (the splits at the end) and by longest match.
TRAINED = f"""top AS MATERIALIZED (SELECT word, freq FROM types ORDER BY freq DESC, seen LIMIT 2000),
room AS MATERIALIZED (SELECT 1000 - 2 - count(DISTINCT c) AS k FROM (SELECT unnest(string_split(word, '')) AS c FROM top)),
steps AS (SELECT word, freq, {_split('bpe')} AS sp, 0 AS k, NULL::VARCHAR AS m FROM top
  UNION ALL SELECT word, freq, replace(sp, '|' || b.a || '||' || b.b || '|', '|' || b.a || b.b || '|'), steps.k + 1, b.a || b.b FROM steps,
  (SELECT p.a, p.b FROM (SELECT freq, unnest(list_transform(range(1, len(toks)), lambda i: struct_pack(a := toks[i], b := toks[i + 1]))) AS p FROM (SELECT freq, {TOKS} AS toks FROM steps)) GROUP BY p ORDER BY sum(freq) DESC, p.a, p.b LIMIT 1) b
  WHERE steps.k < (SELECT k FROM room)),
done AS MATERIALIZED (SELECT * FROM steps),
sa AS MATERIALIZED (SELECT word, {TOKS} AS pieces FROM done WHERE k = (SELECT max(k) FROM done)),
learned AS MATERIALIZED (SELECT DISTINCT m AS v FROM done WHERE m IS NOT NULL UNION SELECT DISTINCT unnest(string_split(word || '_', '')) FROM top),
sb_w AS (SELECT word, word || '_' AS ws, 1 AS pos, []::VARCHAR[] AS pieces FROM top
  UNION ALL SELECT word, ws, pos + max(len(v)), list_append(pieces, arg_max(v, len(v))) FROM sb_w JOIN learned ON starts_with(substr(ws, pos), v) WHERE pos <= len(ws) GROUP BY word, ws, pos, pieces),
sb AS MATERIALIZED (SELECT word, pieces FROM sb_w WHERE pos > len(ws))"""


def _race(name: str, first_seen: bool, size: int) -> str:
    """WordPiece over ``top``, step by step: rows of words with their splits, and one row without a word whose split is
    the vocabulary. With ties by corpus order it ends where the best pair makes a token that is there; else such pairs
    don't count."""
    toks = f"SELECT freq, seen, {TOKS} AS toks FROM {name} WHERE word IS NOT NULL"
    symbols = f"SELECT t AS tok, sum(freq)::DOUBLE AS f FROM (SELECT freq, unnest(toks) AS t FROM ({toks})) GROUP BY t"
    pairs = f"SELECT p.a AS a, p.b AS b, sum(freq)::DOUBLE AS n, min(struct_pack(w := seen, i := p.i)) AS place FROM (SELECT freq, seen, unnest(list_transform(range(1, len(toks)), lambda i: struct_pack(a := toks[i], b := toks[i + 1], i := i))) AS p FROM ({toks})) GROUP BY p.a, p.b"
    made = "p.a || CASE WHEN starts_with(p.b, '##') THEN substr(p.b, 3) ELSE p.b END"
    known = f"contains((SELECT sp FROM {name} WHERE word IS NULL), '|' || {{}} || '|')"
    best = f"SELECT p.a, p.b, {made} AS m FROM ({pairs}) p JOIN ({symbols}) x ON x.tok = p.a JOIN ({symbols}) y ON y.tok = p.b {'' if first_seen else f'WHERE NOT {known.format(made)}'} ORDER BY p.n / (x.f * y.f) DESC, {'p.place' if first_seen else 'p.a, p.b'} LIMIT 1"
    return f"""{name}_0 AS MATERIALIZED (SELECT word, freq, seen, {_split('wp')} AS sp FROM top),
{name} AS (SELECT word, freq, seen, sp, 0 AS k, NULL::VARCHAR AS m, NULL::VARCHAR AS a FROM {name}_0
  UNION ALL SELECT NULL, NULL, NULL, '|[UNK]|' || string_agg('|' || tok || '|', ''), 0, NULL, NULL FROM (SELECT DISTINCT unnest({TOKS}) AS tok FROM {name}_0)
  UNION ALL SELECT word, freq, seen, CASE WHEN word IS NULL THEN sp || '|' || b.m || '|' ELSE replace(sp, '|' || b.a || '||' || b.b || '|', '|' || b.m || '|') END, k + 1, b.m, b.a
  FROM {name}, ({best}) b WHERE NOT {known.format('b.m')} AND (SELECT len({TOKS}) FROM {name} WHERE word IS NULL) < {size}),
{name}_m AS MATERIALIZED (SELECT k, a, m FROM {name} WHERE word IS NULL AND k > 0)"""


def _record(w: str, ge: str) -> str:
    return f"{w}, {GOLD}, {ge}, {RANKED}, {_bpe_surfaces('fs', 'ranked')}, {LEAST}, {_bpe_surfaces('ls', 'least')}, {LINES}, {_bpe_surfaces('ds', 'fert')}, dom AS ({DOMAIN_ROWS}) SELECT 'bpe' AS type, 'wiki' AS train_data, {len(bpe_vocab_list())} AS vocab_size, NULL::INT AS min_pair_freq, g.*, f.*, {_ratio('l.p', 'l.c')} AS on_rare_words, o.* FROM ({GOLD_ROW}) g, ({FREQ_ROW}) f, (SELECT sum(len(pieces)) AS p, count(*) AS c FROM least JOIN ls USING (word)) l, (SELECT max(fertility) FILTER (domain = 'wiki') AS in_domain, max(fertility) FILTER (domain = 'guten') AS out_domain FROM dom) o"


def oracle_sql() -> dict[str, str]:
    w, r = f"WITH {TOKENS}", f"WITH RECURSIVE {TOKENS}"
    bpe, wp = _bpe("seg", "types"), _wordpiece("seg", "types")
    both = f"{r}, {_bpe('sa', 'types')}, {_longest('sb', 'types', bpe_vocab_list())}"
    sp = {k: f"s AS (SELECT word, freq, seen, {_split(k)} AS sp FROM types)" for k in ("bpe", "naive", "wp")}
    scores = f"{w}, {sp['wp']}, f AS (SELECT tok, sum(freq)::BIGINT AS f FROM {SYMBOLS.format('s')} GROUP BY tok), p AS (SELECT a, b, sum(freq)::BIGINT AS n FROM {PAIRS.format('s')} GROUP BY a, b) SELECT a, b, n, n::DOUBLE / (x.f::DOUBLE * y.f::DOUBLE) AS score FROM p JOIN f x ON x.tok = a JOIN f y ON y.tok = b"
    lines = f"(SELECT row_id, {_strip('text')} AS text FROM (SELECT DISTINCT row_id, text FROM wiki_train)) WHERE length(text) >= 10"
    learned = {"bpe": _learner("bpe", False), "naive": _learner("naive", True), "wp": _learner("wp", False, 20), "wp_slow": _learner("wp", True, 20)}
    start = f"SELECT DISTINCT unnest({TOKS}) AS tok FROM s0"
    matrix = " UNION ALL ".join([f"SELECT 'bpe' AS type, '{d}' AS train_data, {v} AS vocab_size, NULL::INT AS min_pair_freq" for d in ("wiki", "guten600", "guten1k2") for v in (10000, 20000)] + [f"SELECT 'wpc', '{d}', {v}, {m}" for d in ("wiki", "guten600", "guten1k2") for v in (10000, 20000) for m in (100, 500)])
    ge = f"{_bpe_surfaces('gs', 'gold')}, gg AS (SELECT word, surfaces AS pieces FROM gold), {_counts('gg', 'gs')}"
    same = f"{r}, {wp}, {_wordpiece_lists('other', 'types')} SELECT count(*) AS n_words, count(*) FILTER (s.pieces IS DISTINCT FROM o.pieces) AS n_different, count(*) FILTER (s.pieces IS DISTINCT FROM o.pieces) = 0 AS same_outputs FROM seg s FULL JOIN other o USING (word)"
    trained = f"{r}, {TRAINED}"
    record = _record(w, ge)
    agree = f"SELECT 1 - ((sum(sx) + sum(sy) - 2 * sum(i)) * sum(n))::DOUBLE / ((sum(n) - sum(sx)) * sum(sy) + sum(sx) * (sum(n) - sum(sy)))::DOUBLE AS kappa, {_ratio('2 * sum(i)', 'sum(sx) + sum(sy)')} AS f1, round(avg(k), 9) AS per_word_kappa, round(avg(f1), 9) AS per_word_f1 FROM per"
    pair = f"{r}, {RANKED}, {_bpe_surfaces('pa', 'ranked')}, {_wp_surfaces('pb', 'ranked')}, {_counts('pa', 'pb')}"
    book = f"first AS (SELECT row_number() OVER (ORDER BY book_id, text) AS nth, string_split(text, chr(10)) AS p FROM (SELECT DISTINCT book_id, text FROM gutenberg)), parts AS (SELECT nth, {_strip('p[i]')} AS text FROM first, unnest(range(1, len(p) + 1)) AS t(i) WHERE {_strip('p[i]')} <> '')"
    split = " UNION ALL ".join(f"SELECT '{x}' AS split, {_strip('text')} AS text FROM wiki_{x}" for x in ("train", "valid", "test"))
    return {
        "lines_written": f"SELECT text, count(*) AS n FROM (SELECT {_strip('text')} AS text FROM wiki_valid) WHERE text <> '' GROUP BY text",
        "splits_written": f"SELECT split, text, count(*) AS n FROM ({split}) WHERE text <> '' GROUP BY split, text",
        "books_written": f"WITH {book} SELECT part, text, count(*) AS n FROM (SELECT 'all' AS part, text FROM parts WHERE nth <= 1200 UNION ALL SELECT 'subset', text FROM parts WHERE nth <= 600) GROUP BY part, text",
        "lines_read": rf"SELECT text, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split_regex(line, '[\r\n]+')), '{SPACE}+$', '') AS text FROM guten_test) GROUP BY text",
        "ranked_words_read": f"{w}, {RANKED} SELECT rank, word FROM ranked",
        "word_counts_read": f"{w} SELECT word, freq FROM types ORDER BY freq DESC, seen LIMIT 2000",
        "vocabulary_written": f"{w}, {sp['wp']} SELECT DISTINCT tok AS token FROM {SYMBOLS.format('s')}",
        "gold_read": f"WITH {GOLD} SELECT word, array_to_string(surfaces, ' ') AS surfaces FROM gold",
        "examples_written": f"WITH RECURSIVE {GOLD}, {_wordpiece('seg', 'gold')} SELECT word AS word_type, array_to_string(pieces, ' ') AS wordpiece_subword_tokens FROM seg",
        "record_written": f"{w} SELECT (SELECT count(text) FROM documents) AS lines, count(*) AS types, coalesce(sum(freq), 0)::BIGINT AS tokens FROM types",
        "eval_log": f"SELECT * FROM ({record}) UNION ALL SELECT * FROM ({record})",
        "learner_comparison": f"{r}, top AS MATERIALIZED (SELECT word, freq, seen FROM types ORDER BY freq DESC, seen LIMIT 2000), {_race('slow', True, 500)}, {_race('fast', False, 500)} SELECT (SELECT count(*) FROM slow_m)::INT AS n_merges, (SELECT count(*) FROM (SELECT m FROM slow_m UNION SELECT m FROM fast_m)) = (SELECT count(*) FROM (SELECT m FROM slow_m INTERSECT SELECT m FROM fast_m)) AS same_vocabulary, (SELECT count(*) FROM (FROM slow_m UNION FROM fast_m)) = (SELECT count(*) FROM (FROM slow_m INTERSECT FROM fast_m)) AS same_merge_sequence",
        "agreement_log": f"{pair} SELECT 'bpe' AS a_type, 'wiki' AS a_train_data, {len(bpe_vocab_list())} AS a_vocab_size, NULL::INT AS a_min_pair_freq, 'wpc' AS b_type, 'wiki' AS b_train_data, {len(wp_vocab_list())} AS b_vocab_size, 100 AS b_min_pair_freq, x.* FROM ({agree}) x",
        "ambiguity_report": f"{trained} SELECT count(*) AS n_words, count(*) FILTER (sa.pieces <> sb.pieces) AS n_ambiguous, {_ratio('count(*) FILTER (sa.pieces <> sb.pieces)', 'count(*)')} AS rate FROM sa JOIN sb USING (word)",
        "ambiguity_examples": f"{trained} SELECT word, freq, array_to_string(sa.pieces, ' ') AS standard, array_to_string(sb.pieces, ' ') AS longest FROM sa JOIN sb USING (word) JOIN top USING (word) WHERE sa.pieces <> sb.pieces ORDER BY freq DESC, word LIMIT 20",
        "word_freq": f"{w} SELECT word, freq FROM types",
        "top_words": f"{w} SELECT word, freq FROM types ORDER BY freq DESC, seen LIMIT 50",
        "corpus_lines": f"SELECT row_id, text FROM {lines}",
        "corpus_lines_limited": f"SELECT row_id, text FROM {lines} ORDER BY row_id LIMIT 500",
        "book_lines": f"SELECT book_id, (i - 1)::INT AS line_no, {_strip('p[i]')} AS text FROM (SELECT DISTINCT book_id, text, string_split(text, chr(10)) AS p FROM gutenberg), unnest(range(1, len(p) + 1)) AS t(i) WHERE {_strip('p[i]')} <> ''",
        "alphabet": f"{w}, {sp['bpe']} SELECT DISTINCT tok AS symbol FROM {SYMBOLS.format('s')}",
        "wp_alphabet": f"{w}, {sp['wp']} SELECT DISTINCT tok AS symbol FROM {SYMBOLS.format('s')}",
        "word_tokens_first_n": f"{w} SELECT doc_id, pos, word FROM tok ORDER BY doc_id, pos LIMIT 1000",
        "rare_words": f"WITH {RARE} SELECT word, freq FROM rare ORDER BY freq, seen DESC LIMIT 1000",
        "word_counts_written": f"WITH {RARE} SELECT freq, word FROM rare",
        "corpus_stats": f"{w} SELECT (SELECT count(text) FROM documents) AS lines, count(*) AS types, coalesce(sum(freq), 0)::BIGINT AS tokens FROM types",
        "fertility_tokens": r"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '[^\pL\pN_]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word",
        "bpe_init_split": f"{w}, {sp['bpe']} SELECT word, sp FROM s",
        "naive_bpe_init_split": f"{w}, {sp['naive']} SELECT word, sp FROM s",
        "wp_init_split": f"{w}, {sp['wp']} SELECT word, sp FROM s",
        "pair_freq": f"{w}, {sp['bpe']} SELECT a, b, sum(freq)::BIGINT AS n FROM {PAIRS.format('s')} GROUP BY a, b",
        "symbol_freq": f"{w}, {sp['wp']} SELECT tok, sum(freq)::BIGINT AS f FROM {SYMBOLS.format('s')} GROUP BY tok",
        "wp_pair_scores": scores,
        "wp_pair_scores_min100": f"{scores} WHERE n >= 100",
        "pair_score": f"SELECT coalesce(max(score) FILTER (a = 't' AND b = '##h'), 0.0) AS score FROM ({scores})",
        "bpe_merges_distributed": f"{learned['bpe']} {BESTS}",
        "wp_merges_distributed": f"{learned['wp']} {BESTS}",
        "merges_written": f"{learned['bpe']} {BESTS}",
        "bpe_merges_lex": f"{learned['bpe']} {BESTS}",
        "bpe_merges_naive": f"{learned['naive']} {BESTS}",
        "wp_merges_lex": f"{learned['wp']} {BESTS}",
        "wp_merges_first_seen": f"{learned['wp_slow']} {BESTS}",
        "bpe_vocab": f"{learned['bpe']} SELECT (row_number() OVER (ORDER BY part, rank, token) - 1)::INT AS id, token FROM (SELECT 0 AS part, i AS rank, token FROM (VALUES (0, '<unk>'), (1, '_')) AS v(i, token) UNION ALL SELECT 1, 0, tok FROM ({start}) WHERE tok <> '_' UNION ALL SELECT 2, rank, merged FROM ({BESTS}))",
        "wp_vocab": f"{learned['wp']} SELECT '[UNK]' AS token UNION ALL SELECT tok FROM ({start}) UNION ALL SELECT merged FROM ({BESTS})",
        "bpe_train_splits": f"{learned['bpe']} SELECT word, freq, sp FROM s{STEPS}",
        "wp_train_splits": f"{learned['wp']} SELECT word, freq, sp FROM s{STEPS}",
        "bpe_tokenize": f"{w}, {bpe} SELECT {JOINED} FROM seg",
        "bpe_longest": f"{r}, {_longest('seg', 'types', bpe_vocab_list())} SELECT {JOINED} FROM seg",
        "bpe_longest_trie": f"{r}, {_longest('seg', 'types', bpe_vocab_list())} SELECT {JOINED} FROM seg",
        "naive_bpe_tokenize": f"{w}, {_bpe('seg', 'types', NAIVE_MERGES, '')} SELECT {JOINED} FROM seg",
        "naive_bpe_longest": f"{r}, {_longest('seg', 'types', naive_vocab_list(), '')} SELECT {JOINED} FROM seg",
        "wp_encode": f"{r}, {wp} SELECT {JOINED} FROM seg",
        "wp_encode_trie": f"{r}, {wp} SELECT {JOINED} FROM seg",
        "wp_encode_joined": f"{r}, {wp} SELECT {JOINED} FROM seg",
        "bpe_longest_joined": f"{r}, {_longest('seg', 'types', bpe_vocab_list())} SELECT {JOINED} FROM seg",
        "wp_tokenize_docs": f"{r}, {wp} SELECT doc_id, count(*) AS n_pieces, count(DISTINCT piece) AS n_different FROM (SELECT doc_id, unnest(pieces) AS piece FROM tok JOIN seg USING (word)) GROUP BY doc_id",
        "wp_trie_equals_baseline": same,
        "segmentation_race": same,
        "wp_type_metrics": f"{r}, {wp} SELECT {_rates('n_types', 'count(*)', '1')} FROM seg",
        "wp_text_metrics": f"{r}, {wp} SELECT {_rates('n_tokens', 'sum(freq)', 'freq')} FROM seg JOIN types USING (word)",
        "wp_output_metrics": f"{r}, {wp} SELECT {_rates('n_tokens', 'sum(freq)', 'freq', False)} FROM seg JOIN types USING (word)",
        "ambiguity_rate": f"{both} SELECT count(*) AS n_words, count(*) FILTER (sa.pieces <> sb.pieces) AS n_ambiguous, {_ratio('count(*) FILTER (sa.pieces <> sb.pieces)', 'count(*)')} AS rate FROM sa JOIN sb USING (word)",
        "ambiguous_top20": f"{both} SELECT word, freq, array_to_string(sa.pieces, ' ') AS standard, array_to_string(sb.pieces, ' ') AS longest FROM sa JOIN sb USING (word) JOIN types USING (word) WHERE sa.pieces <> sb.pieces ORDER BY freq DESC, word LIMIT 20",
        "freq_words_metrics": f"{w}, {RANKED}, {_bpe_surfaces('fs', 'ranked')} {FREQ_ROW}",
        "least_words_fertility": f"{w}, {LEAST}, {_bpe_surfaces('ls', 'least')} SELECT count(*) AS n_words, {_ratio('sum(len(pieces))', 'count(*)')} AS avg_fertility FROM least JOIN ls USING (word)",
        "domain_fertility": f"WITH {LINES}, {_bpe_surfaces('ds', 'fert')} {DOMAIN_ROWS}",
        "wp_domain_fertility": f"WITH RECURSIVE {LINES}, {_wp_surfaces('ds', 'fert')} {DOMAIN_ROWS}",
        "in_out_domain": f"WITH {LINES}, {_bpe_surfaces('ds', 'fert')}, dom AS ({DOMAIN_ROWS}) SELECT max(fertility) FILTER (domain = 'wiki') AS in_domain, max(fertility) FILTER (domain = 'guten') AS out_domain FROM dom",
        "gold_parse": f"WITH {GOLD} SELECT word, array_to_string(surfaces, ' ') AS surfaces FROM gold",
        "boundary_vectors": f"WITH {GOLD} SELECT word, coalesce(array_to_string({_vec('surfaces')}, ''), '') AS vec FROM gold",
        "gold_prf": f"WITH {GOLD}, {ge} {GOLD_ROW}",
        "gold_prf_wp": f"WITH RECURSIVE {GOLD}, {_wp_surfaces('gs', 'gold')}, gg AS (SELECT word, surfaces AS pieces FROM gold), {_counts('gg', 'gs')} {GOLD_ROW}",
        "pairwise_agreement": f"{pair} {agree}",
        "experiment_matrix": matrix,
        "eval_run": record,
    }
