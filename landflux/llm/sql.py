"""SQL that gives the same rows as the registered queries, where SQL can express them."""

OP2_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS raw FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, replace(replace(replace(raw, '\', '\b'), '###', '\h'), '</turn>', '\l') AS body,
    length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\l'), ':', '\c')) + 6 AS head,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, raw) AS place
  FROM turns
), sized AS (
  SELECT *, head + length(body) + 8 AS chars, (strlen(body) + 3) // 4 + 4 AS tokens FROM written
), opened AS (
  SELECT *,
    first_value(CASE WHEN role = 'system' THEN tokens END) OVER w AS system_tokens,
    first_value(CASE WHEN role = 'system' THEN chars END) OVER w AS system_chars,
    sum(tokens) OVER w AS upto,
    lag(tokens, 1) OVER w AS t1, lag(tokens, 2) OVER w AS t2,
    lag(chars, 1) OVER w AS c1, lag(chars, 2) OVER w AS c2
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), strided AS (
  SELECT *, greatest(128, 768 - coalesce(system_tokens, 0)) AS stride,
    upto - coalesce(system_tokens, 0) AS ending,
    greatest(0, upto - coalesce(system_tokens, 0) - tokens) AS beginning
  FROM opened
), placed AS (
  SELECT *, beginning // stride AS span, ending > (beginning // stride + 1) * stride AS beyond FROM strided
), marked AS (
  SELECT *, lag(span, 1, -1) OVER w <> span OR lag(beyond, 1, false) OVER w <> beyond AS starts
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY place)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || raw || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(length(coalesce(string_agg(raw, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(raw, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN starts THEN
    CASE WHEN place > 1 THEN coalesce(system_chars, 0) ELSE 0 END
    + CASE WHEN place > 1 AND t1 <= 256 AND NOT (place = 2 AND system_tokens IS NOT NULL) THEN c1 ELSE 0 END
    + CASE WHEN place > 2 AND t1 + t2 <= 256 AND NOT (place = 3 AND system_tokens IS NOT NULL) THEN c2 ELSE 0 END
  ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP7_MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), text)), 1, 12) AS BIGINT) + 0.5)
      / 281474976710656.0::DOUBLE)
    / (1.0::DOUBLE - 0.75::DOUBLE * length(regexp_replace(text, '[A-Za-z\x20\x{C0}-\x{24F}]+', '', 'g'))
      / greatest(length(text), 1)) AS key
  FROM docs
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER ()
      - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), goal AS (
  SELECT *, least(source_size * 3.0::DOUBLE, weight * (
    SELECT level FROM levels WHERE source_size * 3.0::DOUBLE >= level * weight
    ORDER BY source_size / weight, source NULLS LAST LIMIT 1)) AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM goal
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed
)
SELECT p.doc_id, p.size, b.source_size, b.target,
  CAST((b.epochs + CASE WHEN p.size > 0 AND p.before + p.size / 2.0::DOUBLE <= b.target - b.epochs * b.source_size
    THEN 1 ELSE 0 END) * p.size AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""

OP10_VECTORS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM vectors WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
  SELECT a, min(b) AS least FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, least(v.vec_id, coalesce(s.least, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(s.least, v.vec_id) AS kept
FROM vectors v LEFT JOIN smallest s ON s.a = v.vec_id LEFT JOIN counted c ON c.a = v.vec_id
"""


def url_filters(rules, z, least_labels, smoothing, reject, identifier) -> str:
    """Rules first, then the template trees, one step of a recursion for each level."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [
        f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered
    ]
    rule = " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, ordered, strict=True))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), shaped AS (
  SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS known,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
      lambda s: regexp_replace(s, '{identifier}', '*\1')) AS shape
  FROM split
), prior AS (
  SELECT (count(*) FILTER (known = 'block') + 1.0::DOUBLE) / (count(known) + 2.0::DOUBLE) AS prior FROM shaped
), grown(level, host, shape, bad, labels, template) AS (
  SELECT 0, host, shape, CAST(count(*) FILTER (known = 'block') AS DOUBLE), CAST(count(known) AS DOUBLE), ''
  FROM shaped GROUP BY host, shape
  UNION ALL
  SELECT level + 1, host, shape, bad, labels, template || '/' ||
    CASE WHEN starts_with(segment, '*') OR NOT (an > 1 AND abs(a / an - b / bn)
        > {z}::DOUBLE * sqrt((a + b) / (an + bn) * (1 - (a + b) / (an + bn)) * (1 / an + 1 / bn)))
      THEN '*' ELSE segment END
  FROM (
    SELECT *, sum(bad) OVER child + 0.5::DOUBLE AS a, sum(bad) OVER node - sum(bad) OVER child + 0.5::DOUBLE AS b,
      sum(labels) OVER child + 1.0::DOUBLE AS an, sum(labels) OVER node - sum(labels) OVER child + 1.0::DOUBLE AS bn
    FROM (SELECT *, shape[level + 1] AS segment FROM grown WHERE len(shape) > level)
    WINDOW child AS (PARTITION BY host, template, segment), node AS (PARTITION BY host, template)
  )
), leaves AS (
  SELECT * FROM grown WHERE len(shape) = level
), sums AS (
  SELECT host, template, sum(bad) AS t_bad, sum(labels) AS t_labels FROM leaves GROUP BY host, template
), known_templates AS (
  SELECT s.host, s.shape, s.template, t_labels, (t_bad + {smoothing}::DOUBLE * prior) / (t_labels + {smoothing}::DOUBLE) AS purity
  FROM leaves s JOIN sums USING (host, template), prior
)
SELECT page_id, p.host, path, rule, coalesce(known, CASE WHEN t_labels >= {least_labels} AND purity >= {reject}::DOUBLE
    THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM shaped p JOIN known_templates t ON p.host = t.host AND p.shape = t.shape"""


def quality_rules(common, guard_chars, guard_words, guard_reference, class_distance, word_distance) -> str:
    """Base counts, histograms and Jensen-Shannon distances, all by lists and groups."""
    space = r"\x20\x09-\x0D"
    marks = r""".,;:!?'"()\-\[\]{}/\\_`#*$%&|<>"""
    classes = [
        "[a-z]", "[A-Z]", "[0-9]", f"[{space}]", r"""[.,;:!?'"()\-\[\]{}/\\_`+=@^~]""", "[#*$%&|<>]",
        r"[\x00-\x08\x0E-\x1F\x7F]", r"[\x{80}-\x{7FF}]", r"[\x{800}-\x{FFFF}]", r"[\x{10000}-\x{10FFFF}]",
    ]
    quoted = [c.replace("'", "''") for c in classes]
    counts = ", ".join(f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in quoted)
    shares = ", ".join(f"CAST(sum(classes[{k + 1}]) AS DOUBLE)" for k in range(len(classes)))

    def distance(p: str, q: str, bins: int) -> str:
        def part(x: str, y: str) -> str:
            return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"

        a, b = f"{p}[i] / list_sum({p})", f"{q}[i] / list_sum({q})"
        terms = f"list_sum(list_transform(range(1, {bins + 1}), lambda i: {part(a, b)} + {part(b, a)}))"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({terms} / 2, 0)) ELSE 0 END"

    return f"""WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^{space}]+') AS words, [{counts}] AS classes,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{space}]')) AS lines,
    regexp_extract_all(translate(regexp_replace(text, '[{marks.replace("'", "''")}]', ' ', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{space}]+') AS common
  FROM docs
), windows AS (
  SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM cut, unnest(range(1, len(words) - 1)) AS r(i)
), again AS (
  SELECT id, count(DISTINCT place) AS n_repeat_words FROM (
    SELECT id, unnest([i, i + 1, i + 2]) AS place FROM (
      SELECT *, count(*) OVER (PARTITION BY id, w) AS n FROM windows) WHERE n > 1)
  GROUP BY id
), counted AS (
  SELECT cut.*, len(words) AS n_words, length(regexp_replace(text, '[{space}]', '', 'g')) AS word_chars,
    classes[6] AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM cut LEFT JOIN again USING (id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), totals AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(common) AS word FROM judged WHERE NOT base_failed) GROUP BY ALL
), best AS (
  SELECT lang, list(word ORDER BY n DESC, word) AS best, list(n ORDER BY n DESC, word) AS best_n
  FROM (SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {common}) GROUP BY lang
), known AS (
  SELECT lang, best, sum_n, class_n, list_concat(list_transform(best_n, lambda x: CAST(x AS DOUBLE)),
    [CAST(sum_n - list_sum(best_n) AS DOUBLE)]) AS word_n
  FROM best JOIN (SELECT lang, sum(n) AS sum_n FROM totals GROUP BY lang) USING (lang)
  JOIN (SELECT lang, [{shares}] AS class_n FROM judged WHERE NOT base_failed GROUP BY lang) USING (lang)
), tallied AS (
  SELECT id, map_from_entries(list((word, n))) AS found FROM (
    SELECT id, word, count(*) AS n FROM (SELECT id, unnest(common) AS word FROM judged) GROUP BY ALL) GROUP BY id
), met AS (
  SELECT j.*, k.*  EXCLUDE (lang), list_transform(classes, lambda c: CAST(c AS DOUBLE)) AS own_class,
    list_transform(best, lambda w: CAST(coalesce(found[w], 0) AS DOUBLE)) AS own_words
  FROM judged j LEFT JOIN known k ON j.lang = k.lang LEFT JOIN tallied t ON j.id = t.id
), ready AS (
  SELECT *, list_concat(own_words, [CAST(len(common) - list_sum(own_words) AS DOUBLE)]) AS own_word_bins FROM met
), measured AS (
  SELECT *, CASE WHEN sum_n >= {guard_reference} AND word_chars >= {guard_chars}
      THEN {distance("own_class", "class_n", len(classes))} END AS by_class,
    CASE WHEN sum_n >= {guard_reference} AND n_words >= {guard_words}
      THEN {distance("own_word_bins", "word_n", common + 1)} END AS by_word
  FROM ready
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  round(by_class, 6) AS class_distance, round(by_word, 6) AS word_distance,
  NOT base_failed AND coalesce(by_class, 0) <= {class_distance} AND coalesce(by_word, 0) <= {word_distance} AS kept
FROM measured"""


def secret_scans(access, hex_, run, least_value, classes, allowed) -> str:
    """Matches and the pieces between them give the places; windows are counted anew for the entropy."""
    words = ["password", "passwd", "secret", "token", "api_?key"]
    cased = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)
    assign = rf"""({cased})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [("assign", assign), ("access", access), ("hex", hex_), ("run", run)]
    hits = " UNION ALL ".join(
        f"""SELECT id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(text, '{p}') AS m,
    string_split_regex(text, '{p}') AS gaps FROM docs"""
        for rank, (kind, p) in enumerate(patterns)
    )
    plain = [f"NOT regexp_matches(value, '{p}')" for p in allowed if r"\1" not in p]
    repeated = [
        f"NOT (length(value) >= {2 * n} AND length(value) % {n} = 0 AND value = repeat(value[1:{n}], length(value) // {n}))"
        for n in range(1, 5)
    ]
    kinds = []
    for rank, c in enumerate(classes, start=3):
        needs = " AND ".join(f"regexp_matches(value, '{p}')" for p in c.needs)
        kinds.append(
            f"""SELECT id, '{c.kind}' AS kind, {rank} AS rank, start, ending FROM (
    SELECT *, list_max(list_transform(range(1, length(value) - {c.window} + 2), lambda i:
      list_sum(list_transform(list_distinct(string_split(value[i:i + {c.window - 1}], '')), lambda ch:
        -(len(list_filter(string_split(value[i:i + {c.window - 1}], ''), lambda x: x = ch)) / {c.window}.0::DOUBLE)
        * log2(len(list_filter(string_split(value[i:i + {c.window - 1}], ''), lambda x: x = ch)) / {c.window}.0::DOUBLE))))) AS bits
    FROM placed WHERE kind = 'run' AND {needs} AND {" AND ".join(plain + repeated)}) WHERE bits >= {c.least}::DOUBLE"""
        )
    count = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    text = "kind || ':' || start || ':' || ending"
    return f"""WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), hits AS ({hits}), placed AS (
  SELECT id, kind, rank, m[k] AS value, start, start + length(m[k]) AS ending FROM (
    SELECT *, list_sum(list_transform(gaps[1:k], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
    FROM hits, unnest(range(1, len(m) + 1)) AS r(k))
), base AS (
  SELECT id, kind, rank, start, ending FROM placed
  WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(regexp_extract(value, '{assign}', 2)) >= {least_value}
), added AS ({" UNION ALL ".join(kinds)}), spans AS (
  SELECT * FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE a.id = b.id AND b.start < a.ending AND a.start < b.ending)
), joined AS (
  SELECT id, {count("assign")}, {count("access")}, {count("hex")},
    string_agg({text}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({text}, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (id)"""


def _least_edits(q: int) -> str:
    """Cheapest edits of a row and all that follow from state ``q``, without inserts before the row."""
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
    after = {0: 2, 1: 2, 2: 3, 3: 2}[q]
    kept = " ".join(f"WHEN '{role}' THEN {{'c': v[{to + 1}].c + f.cut, 'a': 'K' || v[{to + 1}].a}}" for role, to in keep.items())
    return (
        f"list_sort(list_filter([{{'c': v[{q + 1}].c + 3, 'a': 'D' || v[{q + 1}].a}}, "
        f"CASE WHEN f.gone THEN NULL ELSE CASE f.initial {kept} END END, "
        f"CASE WHEN f.gone THEN NULL ELSE {{'c': v[{after + 1}].c + f.cut + 2, 'a': 'R' || v[{after + 1}].a}} END"
        "], lambda x: x IS NOT NULL))[1]"
    )


def _with_inserts(q: int) -> str:
    after = (2, 2, 3, 2)
    one, two = after[q] + 1, after[after[q]] + 1
    return (
        f"list_sort([p[{q + 1}], {{'c': p[{one}].c + 2, 'a': 'I' || p[{one}].a}}, "
        f"{{'c': p[{two}].c + 4, 'a': 'II' || p[{two}].a}}])[1]"
    )


# The checksum takes a byte's eight bits one by one: the byte is mixed in before the first.
OP13_TURNS = rf"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS signs
  FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(signs, lambda s: [CAST(ord(s) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) >> 1, CAST(3988292384 AS BIGINT)) ELSE xor(c, x) >> 1 END
    ), CAST(4294967295 AS BIGINT)) % 20 AS fault
  FROM told
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed
), placed AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), faulted AS (
  SELECT conv_id, i, role, text, initial, blank OR again AS gone,
    CAST(open AND NOT blank AND NOT again AS INTEGER) AS cut
  FROM judged
), counted AS (
  SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), solved AS (
  SELECT conv_id, n AS i, [{{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS v
  FROM counted
  UNION ALL
  SELECT conv_id, i - 1, [{', '.join(_with_inserts(q) for q in range(4))}] FROM (
    SELECT s.conv_id, s.i, [{', '.join(_least_edits(q) for q in range(4))}] AS p
    FROM solved s JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i)
), audits AS (
  SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM solved WHERE i = 0
), letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS k
  FROM audits WHERE audit <> ''
), numbered AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), standing AS (
  SELECT l.conv_id, l.k, l.letter, f.role, CASE WHEN l.letter = 'I' THEN '' ELSE f.text END AS text,
    row_number() OVER w AS place, first_value(CASE WHEN l.letter = 'K' THEN f.initial ELSE '' END) OVER w = 's' AS has_s
  FROM numbered l LEFT JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.letter <> 'I'
  WHERE l.letter <> 'D' WINDOW w AS (PARTITION BY l.conv_id ORDER BY l.k)
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role
      WHEN (place - CAST(has_s AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS digest
  FROM standing GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
