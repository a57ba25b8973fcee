"""Plain SQL for the queries of this folder that it can express."""

from __future__ import annotations

from lexiloom.llm.mixing import RANKS

#: The rows of word_freqs that count, each once.
TERMS = """rows AS (SELECT DISTINCT row_id, chunk_id, lower(trim(word, ' ' || chr(9))) AS term, freq FROM word_freqs
  WHERE trim(word, ' ' || chr(9)) <> '' AND freq > 0),
terms AS (SELECT term, sum(freq)::BIGINT AS total, count(DISTINCT chunk_id) AS records FROM rows GROUP BY term),
marks AS (SELECT term, total, records, total < 5 OR records <= 1 AS rare,
  records > 0 AND records >= 0.3 * (SELECT count(DISTINCT chunk_id) FROM rows) AS common FROM terms)"""

#: (book_id, source, line_no, raw, letters) of gutenberg.
LINES = r"""books AS (SELECT DISTINCT book_id, text, nullif(lower(trim(source, ' ' || chr(9))), '') AS source FROM gutenberg),
split AS (SELECT book_id, source, text, string_split(text, chr(10)) AS parts FROM books WHERE source IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT book_id, source, text, i - 1 AS line_no, regexp_replace(parts[i], '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS raw,
  lower(regexp_replace(parts[i], '[^\pL]+', '', 'g')) AS letters FROM split, unnest(range(1, len(parts) + 1)) AS t(i)),
good AS (SELECT * FROM lines WHERE length(raw) >= 10 AND letters <> ''),
often AS (SELECT source, letters FROM good GROUP BY ALL HAVING count(DISTINCT book_id) >= 5),
marked AS (SELECT DISTINCT book_id, source, text, line_no, letters FROM good JOIN often USING (source, letters))"""

#: (source, pattern, ...): each sequence of frequent lines grows by the first place of each line behind it, as long as
#: five books of the source have it.
SEQUENCES = rf"""{LINES},
docs AS MATERIALIZED (SELECT source, book_id, dense_rank() OVER (ORDER BY source, book_id, text) AS d, line_no::INTEGER AS line_no, md5(letters) AS h FROM marked),
grow AS (SELECT source, book_id, d, line_no AS s, line_no AS e, h AS p, 1 AS k FROM docs
  UNION ALL SELECT g.source, g.book_id, g.d, g.s, min(n.line_no), g.p || n.h, g.k + 1
  FROM (SELECT *, count(DISTINCT book_id) OVER (PARTITION BY source, p) AS c FROM grow) g JOIN docs n ON n.d = g.d AND n.line_no > g.e
  WHERE c >= 5 GROUP BY g.source, g.book_id, g.d, g.s, g.e, g.p, g.k, n.h)"""

#: (item_id, book_id) by all windows of twelve words.
LEAKS = r"""items AS (SELECT item_id, set_name, regexp_extract_all(lower(line), '[a-z]+(?:''[a-z]+)?') AS w FROM guten_test),
texts AS (SELECT DISTINCT book_id, text FROM gutenberg),
books AS (SELECT book_id, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS w FROM texts),
wins AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM items, unnest(range(1, len(w) - 10)) AS t(i)),
grams AS (SELECT book_id, array_to_string(w[i:i + 11], ' ') AS g FROM books, unnest(range(1, len(w) - 10)) AS t(i)),
pairs AS (SELECT DISTINCT item_id, book_id FROM wins JOIN grams USING (g))"""

#: (eval_split, eval_id, train_id): pairs that share enough words, then the word edit distance row by row. The next
#: row's entry j is j plus the smallest t(k) - k up to j, where t(k) comes from above or by a change.
OVERLAPS = r"""evals AS (SELECT DISTINCT 'valid' AS eval_split, row_id, text FROM wiki_valid UNION SELECT DISTINCT 'test', row_id, text FROM wiki_test),
ev AS MATERIALIZED (SELECT * FROM (SELECT eval_split, row_id AS eval_id, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS a FROM evals) WHERE len(a) >= 10),
tr AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT row_id AS train_id, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS b FROM wiki_train) WHERE len(b) >= 10),
ebag AS (SELECT eval_split, eval_id, len(a) AS n, word, count(*) AS c FROM (SELECT *, unnest(a) AS word FROM ev) GROUP BY ALL),
tbag AS (SELECT train_id, len(b) AS n, word, count(*) AS c FROM (SELECT *, unnest(b) AS word FROM tr) GROUP BY ALL),
cand AS MATERIALIZED (SELECT eval_split, eval_id, train_id FROM ebag e JOIN tbag t USING (word)
  GROUP BY eval_split, eval_id, train_id, e.n, t.n HAVING 100 * sum(least(e.c, t.c)) >= 85 * greatest(e.n, t.n)),
dp AS (SELECT eval_split, eval_id, train_id, a, b, 0 AS i, range(0, len(b) + 1) AS d FROM cand JOIN ev USING (eval_split, eval_id) JOIN tr USING (train_id)
  UNION ALL SELECT eval_split, eval_id, train_id, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: j + list_min(t[1:j + 1]))
  FROM (SELECT *, list_transform(range(0, len(b) + 1), lambda k: CASE WHEN k = 0 THEN i + 1 ELSE least(d[k] + CASE WHEN a[i + 1] = b[k] THEN 0 ELSE 1 END, d[k + 1] + 1) - k END) AS t FROM dp WHERE i < len(a))),
near AS (SELECT eval_split, eval_id, train_id FROM dp WHERE i = len(a) AND 100 * d[len(b) + 1] <= 15 * greatest(len(a), len(b)))"""

# Fixed value: white space as the tokenizer has it.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: (doc_id, ids): pieces are hex strings, and the pair whose bytes together rank first is merged, from the left. A mark
#: before the last white space of a run stands in for the pattern's look-ahead.
IDS = rf"""ranks AS MATERIALIZED (SELECT hex(from_base64(b)) AS h, id FROM read_csv('{RANKS}', delim = ' ', header = false, quote = '', escape = '', columns = {{'b': 'VARCHAR', 'id': 'INTEGER'}})),
parts AS (SELECT doc_id, string_split(regexp_replace(text, '([{SPACE}]+)([{SPACE}][^{SPACE}])', '\1' || chr(57344) || '\2', 'g'), chr(57344)) AS p FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, i, regexp_extract_all(p[i], '''s|''t|''re|''ve|''m|''ll|''d| ?\pL+| ?\pN+| ?[^{SPACE}\pL\pN]+|[{SPACE}]+') AS w FROM parts, unnest(range(1, len(p) + 1)) AS t(i)),
tok AS MATERIALIZED (SELECT doc_id, i, j, w[j] AS w FROM pieces, unnest(range(1, len(w) + 1)) AS t(j)),
bpe AS (SELECT w, list_transform(range(0, len(x) // 2), lambda k: x[2 * k + 1:2 * k + 2]) AS t FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM tok))
  UNION ALL SELECT w, t[1:best.i - 1] || [t[best.i] || t[best.i + 1]] || t[best.i + 2:] FROM
  (SELECT w, t, min(struct_pack(id := id, i := i)) AS best FROM bpe, unnest(range(1, len(t))) AS u(i) JOIN ranks ON h = t[i] || t[i + 1] GROUP BY w, t)),
final AS (SELECT w, arg_min(t, len(t)) AS t FROM bpe GROUP BY w),
done AS MATERIALIZED (SELECT w, list(id ORDER BY k) AS ids FROM (SELECT w, k, t[k] AS h FROM final, unnest(range(1, len(t) + 1)) AS u(k)) JOIN ranks USING (h) GROUP BY w),
docs AS (SELECT doc_id, flatten(list(ids ORDER BY i, j)) AS ids FROM tok JOIN done USING (w) GROUP BY doc_id)"""

#: (n, term, total, records): all n-grams of up to three words of the texts.
NGRAMS = r"""w AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS w FROM documents),
grams AS (SELECT n::INT AS n, r, array_to_string(w[i:i + n - 1], ' ') AS term FROM w, unnest(range(1, 4)) AS a(n), unnest(range(1, len(w) + 2 - n)) AS b(i))"""

#: (mix_id, source, ...): the tokens of each source and what its mixes take of them.
QUOTAS = rf"""{IDS},
sizes AS (SELECT source, len(ids) AS tokens FROM docs JOIN documents USING (doc_id) WHERE source IS NOT NULL),
have AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS documents FROM sizes WHERE tokens > 0 GROUP BY source),
rows AS (SELECT mix_id, source, sum(target_share) AS weight, min(CASE WHEN max_repeats < 0 THEN 0 ELSE max_repeats END) AS cap FROM mix_targets WHERE mix_id IS NOT NULL AND source IS NOT NULL AND target_share > 0 GROUP BY mix_id, source),
shares AS (SELECT mix_id, source, cap, weight / sum(weight) OVER (PARTITION BY mix_id) AS share, coalesce(tokens, 0) AS tokens, coalesce(documents, 0) AS documents FROM rows LEFT JOIN have USING (source)),
whole AS (SELECT *, least(sum(tokens) OVER (PARTITION BY mix_id)::DOUBLE, min(CASE WHEN tokens > 0 AND cap > 0 THEN cap * tokens / share END) OVER (PARTITION BY mix_id)) AS total FROM shares),
quotas AS (SELECT mix_id, source, tokens, documents, floor(share * total + 0.5)::BIGINT AS wanted_tokens, CASE WHEN tokens > 0 THEN least(floor(share * total + 0.5)::BIGINT, tokens * cap) ELSE 0 END AS quota FROM whole)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {LINES} SELECT DISTINCT book_id, line_no::BIGINT AS line_no FROM marked",
        "p1_sequences": f"WITH RECURSIVE {SEQUENCES} SELECT source, md5(unhex(p)) AS pattern, k AS lines, count(DISTINCT book_id) AS books, count(*) AS places, min(struct_pack(b := book_id, s := s, e := e)).b AS book_id, min(struct_pack(b := book_id, s := s, e := e)).s AS start_no, min(struct_pack(b := book_id, s := s, e := e)).e AS end_no FROM grow GROUP BY source, p, k HAVING count(DISTINCT book_id) >= 5",
        "p1_cleaned": f"WITH {LINES} SELECT book_id, CASE WHEN source IS NULL OR text IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(coalesce(drops, []), i - 1)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text FROM books LEFT JOIN (SELECT book_id, source, text, list(line_no) AS drops FROM marked GROUP BY ALL) USING (book_id, source, text)",
        "p2_found": f"WITH {TERMS} SELECT term AS word, 'rare' AS mark FROM marks WHERE rare UNION ALL SELECT term, 'common' FROM marks WHERE common",
        "p2_terms": f"WITH {TERMS} SELECT term, total, records, rare, common FROM marks",
        "p2_ngrams": f"WITH {NGRAMS} SELECT n, term, count(*) AS total, count(DISTINCT r) AS records FROM grams GROUP BY n, term",
        "p3_found": f"WITH {TERMS} SELECT term AS word FROM terms WHERE total * 500 >= (SELECT sum(total) FROM terms)",
        "p3_heavy": f"WITH {TERMS} SELECT term, total FROM terms WHERE total * 500 >= (SELECT sum(total) FROM terms)",
        "p4_found": f"WITH RECURSIVE {OVERLAPS} SELECT eval_split, eval_id, train_id FROM near",
        "p4_report": f"WITH RECURSIVE {OVERLAPS} SELECT eval_split, source, count(*) AS pairs, count(DISTINCT eval_id) AS eval_rows, count(DISTINCT train_id) AS train_rows FROM near JOIN (SELECT DISTINCT 'valid' AS eval_split, row_id AS eval_id, source FROM wiki_valid UNION SELECT DISTINCT 'test', row_id, source FROM wiki_test) USING (eval_split, eval_id) GROUP BY eval_split, source",
        "p5_found": f"WITH {LEAKS} SELECT item_id, book_id FROM pairs",
        "p5_report": f"WITH {LEAKS} SELECT book_id, count(*)::INTEGER AS n_items, list(item_id ORDER BY item_id) AS items FROM pairs GROUP BY book_id",
        "p6_ids": f"WITH RECURSIVE {IDS} SELECT doc_id, coalesce(ids, []::INTEGER[]) AS ids FROM (SELECT doc_id FROM documents) LEFT JOIN docs USING (doc_id)",
        "p7_quotas": f"WITH RECURSIVE {QUOTAS} SELECT mix_id, source, tokens, documents, wanted_tokens, quota, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE quota END AS rest FROM quotas",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
