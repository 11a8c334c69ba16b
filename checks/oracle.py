"""The same results in SQL over the given tables, written without the library."""

from __future__ import annotations

# Separators of the two cleaning profiles, in the regular expressions of the SQL engine.
FULL = r"""[\t-\r\x1c-\x20\x85\p{Z}=+.!?;,/\\_。$%^*(":\-@#&|\[\]<>)]+"""
TAGS = r"""[\t-\r\x1c-\x20\x85\p{Z}+.!?,/_$%^*(":\-@#&)]+"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def _bucket(*keys: str, seed: int | str = 7, start: str = "1") -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {text})), {start}, 15) AS BIGINT)"


# Text -------------------------------------------------------------------------------------

CORPUS = """corpus AS (
  SELECT doc_id, text || chr(10) || 'ID=' || doc_id || ' ' || source || chr(10) || lang
    || ' 😘😘 it''s '''' so '' ' || source || '!!! love ❤️ 1234567890123 very👍🏽nice　a。b' AS text
  FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM corpus))"""

NOISE = """(contains(lower(line), 'id=') OR contains(line, '|||') OR contains(line, '>>>')
  OR contains(line, '•') OR contains(line, '●') OR contains(line, '╭━╮'))"""

SYMBOLS = r"'(\p{So}\p{Sk}*)', ' \1 ', 'g'"


def _full_words(line: str) -> str:
    spaced = f"regexp_replace(lower({line}), {_q(FULL)}, ' ', 'g')"
    bare = rf"regexp_replace({spaced}, '\p{{Nd}}{{10}}', ' ', 'g')"
    return f"string_split_regex(trim(regexp_replace({bare}, {SYMBOLS})), ' +')"


def _tag_words(line: str) -> str:
    bare = f"regexp_replace(lower({line}), '(?s)<.*>', ' ', 'g')"
    spaced = f"regexp_replace({bare}, {_q(TAGS)}, ' ', 'g')"
    return f"string_split_regex(trim(regexp_replace({spaced}, {SYMBOLS})), ' +')"


def _cut(words: str, marks: list[str]) -> str:
    spots = ", ".join(f"nullif(list_position({words}, {_q(m)}), 0)" for m in marks)
    spot = f"coalesce({spots}, 0)"
    return f"CASE WHEN {spot} > 0 THEN list_concat({words}[1:{spot} - 1], {words}[{spot} + 1:]) ELSE {words} END"


def _tokens(name: str, lines: str, key: str) -> str:
    return f"""{name}_words AS (SELECT {key}, line_no, {_full_words('line')} AS w FROM {lines} WHERE NOT {NOISE}),
{name} AS (SELECT {key}, line_no, {_cut('w', ["'", "''"])} AS tokens FROM {name}_words WHERE len(w) > 1)"""


def _tag_tokens(marks: list[str]) -> str:
    kept = _cut("w", marks) if marks else "w"
    return f"""{CORPUS},
page_lines AS (
  SELECT page_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT page_id, string_split(html, chr(10)) AS parts FROM pages)),
marked AS (
  SELECT 'document' AS kind, doc_id AS id, line_no, line FROM lines
  UNION ALL SELECT 'page', page_id, line_no, line FROM page_lines),
words AS (SELECT kind, id, line_no, {_tag_words('line')} AS w FROM marked),
sentences AS (SELECT kind, id, line_no, {kept} AS tokens FROM words WHERE len(w) > 1)"""


SENTENCES = CORPUS + ",\n" + _tokens("sentences", "lines", "doc_id")


def _vocab(min_count: int, marks: list[str], where: str = "true") -> str:
    base = f"""freq AS (SELECT word, count(*) AS freq FROM (SELECT unnest(tokens) AS word FROM sentences) GROUP BY word),
ranked AS (SELECT word, row_number() OVER (ORDER BY freq DESC, word) AS id, freq FROM freq WHERE freq > {min_count} AND {where})"""
    rows = "".join(
        f" UNION ALL SELECT {_q(m)}, (SELECT count(*) FROM ranked) + {i}, NULL" for i, m in enumerate(marks, 1)
    )
    return base + f",\nvocab AS (SELECT word, id, freq FROM ranked{rows})"


def _encoded(name: str, sentences: str, key: str) -> str:
    return f"""{name}_known AS (
  SELECT {key}, line_no, list(v.id ORDER BY pos) AS ids
  FROM (SELECT {key}, line_no, unnest(tokens) AS word, unnest(range(len(tokens))) AS pos FROM {sentences}) t
  JOIN ranked v USING (word) GROUP BY ALL),
{name}_ended AS (
  SELECT {key}, line_no, list_append(ids, (SELECT id FROM vocab WHERE word = '!'))[1:21] AS ids
  FROM {name}_known WHERE len(ids) >= 2),
{name} AS (
  SELECT {key}, line_no, ids,
    list_resize(ids, (SELECT max(len(ids)) FROM {name}_ended), 0) AS padded
  FROM {name}_ended)"""


SEQUENCES = ",\n".join([SENTENCES, _vocab(1, ["!"]), _encoded("sequences", "sentences", "doc_id")])


def _whole(name: str, sentences: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}, line_no, list_append(list(v.id ORDER BY pos), (SELECT id FROM vocab WHERE word = '!')) AS ids
  FROM (SELECT {key}, line_no, unnest(tokens) AS word, unnest(range(len(tokens))) AS pos FROM {sentences}) t
  JOIN ranked v USING (word) GROUP BY ALL)"""


WHOLE = ",\n".join([SENTENCES, _vocab(1, ["!"]), _whole("sequences", "sentences", "doc_id")])

TEXT = {
    "vocab_full": _with(SENTENCES, _vocab(2, ["!", "$"])) + "SELECT word, id, freq FROM vocab",
    "vocab_tags": _with(_tag_tokens([]), _vocab(0, [], "word <> ''''")) + "SELECT word, id, freq FROM vocab",
    "noise_lines": _with(CORPUS)
    + f"SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {NOISE}) AS noise FROM lines GROUP BY doc_id",
    "sentence_tokens": _with(SENTENCES)
    + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, array_to_string(tokens, ' ') AS words FROM sentences",
    "tagged_tokens": _with(_tag_tokens(["'"]))
    + "SELECT kind, id, CAST(line_no AS INTEGER) AS line_no, array_to_string(tokens, ' ') AS words FROM sentences",
    "word_counts": _with(SENTENCES, _vocab(1, [])) + "SELECT word, freq FROM freq WHERE freq > 1",
    "context_profiles": _with(
        SENTENCES,
        _vocab(2, ["!", "$"]),
        """places AS (
  SELECT doc_id, line_no, unnest(list_concat(['$'], tokens, ['!'])) AS word, unnest(range(len(tokens) + 2)) AS pos
  FROM sentences),
known AS (SELECT doc_id, line_no, pos, id FROM places JOIN vocab USING (word)),
ahead AS (SELECT doc_id, line_no, id, pos + unnest([1, 2, 3]) AS pos FROM known),
pairs AS (
  SELECT a.id AS x, b.id AS y FROM ahead a JOIN known b USING (doc_id, line_no, pos)),
both_ways AS (SELECT x AS center, y AS context FROM pairs UNION ALL SELECT y, x FROM pairs)""",
    )
    + """SELECT center, count(DISTINCT context) AS contexts, count(*) AS pairs, CAST(sum(context) AS BIGINT) AS id_sum
FROM both_ways GROUP BY center""",
    "word_pairs": _with(
        SENTENCES,
        """ahead AS (
  SELECT doc_id, unnest(tokens[1:-(gap + 1)]) AS x, unnest(tokens[gap + 1:]) AS y
  FROM sentences, range(1, 5) g(gap) WHERE len(tokens) > gap),
both_ways AS (SELECT doc_id, x AS center, y AS context FROM ahead UNION ALL SELECT doc_id, y, x FROM ahead)""",
    )
    + """SELECT doc_id, count(*) AS pairs, count(*) FILTER (WHERE center = context) AS repeats,
  min(center) AS first_center, max(context) AS last_context FROM both_ways GROUP BY doc_id""",
    "encoded_sequences": _with(SEQUENCES)
    + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, array_to_string(padded, ' ') AS ids FROM sequences",
    "lm_targets": _with(SEQUENCES)
    + """SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, array_to_string(padded, ' ') AS inputs,
  array_to_string(list_append(padded[2:], 0), ' ') AS targets FROM sequences""",
    "prime_words": _with(SEQUENCES)
    + """SELECT ids[1] AS prime, count(*) AS sentences, any_value(word) AS word
FROM sequences JOIN vocab ON vocab.id = ids[1] GROUP BY ids[1]""",
    "sequence_sizes": _with(SEQUENCES)
    + """SELECT count(*) AS sequences, CAST(max(len(ids)) AS INTEGER) AS longest, CAST(min(len(ids)) AS INTEGER) AS shortest,
  CAST(max(len(padded)) AS INTEGER) AS padded FROM sequences""",
    "sequence_batches": _with(
        SEQUENCES,
        "placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS spot, count(*) OVER () AS n FROM sequences)",
    )
    + """SELECT CAST(floor(spot / 128) AS BIGINT) AS batch, count(*) AS rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM placed WHERE spot < n - n % 128 GROUP BY ALL""",
}

# Comments ---------------------------------------------------------------------------------

PEOPLE = """people AS (
  SELECT c_custkey + CASE WHEN c_acctbal < 0 THEN 5::BIGINT << 48 ELSE 0 END AS user_id, c_nationkey AS country_code
  FROM customer),
humans AS (SELECT DISTINCT user_id, country_code FROM people WHERE user_id >> 48 <> 5)"""

GROUPS = """replied AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'),
recordings AS (
  SELECT l_orderkey AS recording_id, CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS owner, l_linenumber AS media_type
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber IN (1, 2, 5, 6, 7, 8)),
grouped AS (
  SELECT media_type, o_orderkey AS id, o_custkey AS user_id, recording_id, o_orderpriority AS comment, country_code
  FROM orders
  JOIN humans ON o_custkey = user_id
  JOIN replied ON o_orderkey = replied.id
  JOIN recordings ON o_orderkey = recording_id
  WHERE o_custkey IS DISTINCT FROM owner)"""

COMMENTS = {
    "active_users": _with(PEOPLE) + "SELECT user_id, country_code FROM humans WHERE country_code = 8",
    "replied_openers": """SELECT conv_id + 1 AS id, role, text AS comment FROM conversations c
WHERE turn = 0 AND EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn > 0)""",
    "comment_groups": _with(PEOPLE, GROUPS)
    + "SELECT media_type, id, user_id, recording_id, comment FROM grouped WHERE country_code = 8",
    "country_comment_counts": _with(PEOPLE, GROUPS)
    + """SELECT country_code, media_type, count(*) AS comments, count(DISTINCT user_id) AS people
FROM grouped GROUP BY country_code, media_type""",
    "routed_comments": _with(PEOPLE, GROUPS)
    + "SELECT media_type, comment, count(*) AS rows FROM grouped WHERE country_code = 8 GROUP BY media_type, comment",
}

# Search log -------------------------------------------------------------------------------

DAY_EVENTS = """day_events AS (
  SELECT event_id, CASE WHEN value < 1 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN event_type <> 'error' THEN user_id END AS song_id,
    CASE WHEN event_type <> 'view' THEN user_id + 1 END AS album_id,
    CASE WHEN event_type <> 'signup' THEN user_id + 2 END AS playlist_id,
    CASE WHEN event_type = 'purchase' THEN user_id + 3 END AS singer_id,
    event_type AS type, ts, value, strftime(ts, '%Y%m%d') AS dt FROM events),
whole_ids AS (
  SELECT event_id, coalesce(user_id, -1) AS user_id, coalesce(song_id, -1) AS song_id, coalesce(album_id, -1) AS album_id,
    coalesce(playlist_id, -1) AS playlist_id, coalesce(singer_id, -1) AS singer_id, type, ts, dt FROM day_events)"""

SEARCH = """asked_events AS (
  SELECT o_custkey AS user_id, l_partkey AS song, CAST(l_linenumber AS BIGINT) AS album, l_orderkey AS playlist, l_suppkey AS singer,
    CASE l_returnflag WHEN 'R' THEN 'click' WHEN 'A' THEN 'show' ELSE 'other' END AS action,
    string_split(p_name, ' ')[1] AS keyword,
    ['songs', 'albums', 'singers', 'playlist', 'song', 'singer', 'playlists'][l_linenumber] AS asked,
    strftime(o_orderdate, '%Y%m%d') AS ts,
    strftime(CASE WHEN l_returnflag = 'N' THEN o_orderdate ELSE l_shipdate END, '%Y%m%d') AS dt,
    l_orderkey AS ord, l_linenumber AS pos, CAST(l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
search_events AS (
  SELECT *, CASE asked WHEN 'songs' THEN 'song' WHEN 'albums' THEN 'album' WHEN 'singers' THEN 'singer' ELSE asked END AS type
  FROM asked_events)"""

CATALOG = """entries AS (
  SELECT p_partkey AS id, list_distinct(string_split_regex(lower(p_name || ' ' || p_type), '\\s+')) AS words FROM part),
postings AS (SELECT id, unnest(words) AS word FROM entries),
weights AS (SELECT word, ln(1 + (SELECT count(*) FROM entries) / count(*)) AS weight FROM postings GROUP BY word)"""


def _found(asked: str) -> str:
    return f"""asked AS ({asked}),
asked_words AS (
  SELECT DISTINCT keyword, unnest(string_split_regex(lower(keyword), '\\s+')) AS word FROM asked),
hits AS (
  SELECT keyword, id, sum(weight) AS score
  FROM asked_words JOIN postings USING (word) JOIN weights USING (word) GROUP BY keyword, id),
found AS (
  SELECT keyword, id, score, row_number() OVER (PARTITION BY keyword ORDER BY round(score, 9) DESC, id) AS rank FROM hits
  QUALIFY rank <= 100)"""


def _labelled(open_until: int) -> str:
    """Rows of the labelling rules; a clicked song up to this position does not end the list."""
    return f"""numbered AS (
  SELECT *, row_number() OVER () AS eid,
    CASE action WHEN 'click' THEN 100 WHEN 'show' THEN 10 ELSE 0 END AS seen,
    CASE type WHEN 'song' THEN song WHEN 'album' THEN album WHEN 'playlist' THEN playlist WHEN 'singer' THEN singer END AS clicked
  FROM search_events),
candidates AS (
  SELECT e.*, f.rank - 1 AS position, f.id AS candidate
  FROM numbered e JOIN found f ON f.keyword = e.keyword AND f.rank <= e.seen),
marked AS (
  SELECT *, min(CASE WHEN candidate = clicked AND (type <> 'song' OR position > {open_until}) THEN position END)
      OVER (PARTITION BY eid) AS stop,
    bool_or(type = 'song' AND position = 0 AND (candidate = singer OR candidate = album)) OVER (PARTITION BY eid) AS misdirected
  FROM candidates),
examined AS (
  SELECT *, CASE WHEN misdirected THEN position = 0 ELSE position <= coalesce(stop, 100) END AS looked
  FROM marked),
labelled AS (
  SELECT *, CAST(candidate = clicked AS INTEGER) AS hit FROM examined
  WHERE looked AND type IN ('song', 'album', 'playlist', 'singer')
    AND (type <> 'song' OR (position > 0 AND NOT misdirected)))"""


FIRST_WORDS = _found("SELECT DISTINCT string_split(p_name, ' ')[1] AS keyword FROM part")

SEARCH_LOG = {
    "day_events": _with(DAY_EVENTS) + "SELECT event_id, user_id, type, dt FROM day_events WHERE dt = '20240115' AND value >= 10",
    "trailing_events": _with(DAY_EVENTS)
    + """SELECT dt, type, count(*) AS events, count(user_id) AS known FROM day_events
WHERE dt BETWEEN '20240109' AND '20240115' GROUP BY dt, type""",
    "collected_events": _with(DAY_EVENTS)
    + """SELECT event_id, user_id, song_id, album_id, playlist_id, singer_id, type, dt FROM whole_ids
WHERE dt BETWEEN '20240109' AND '20240115' AND type = 'click'
  AND user_id IN (SELECT user_id FROM day_events WHERE type = 'purchase' AND value >= 100)""",
    "missing_ids": _with(DAY_EVENTS)
    + "SELECT event_id, user_id, song_id, album_id, playlist_id, singer_id FROM whole_ids",
    "sequence_ids": _with(DAY_EVENTS)
    + """SELECT row_number() OVER (ORDER BY dt DESC, ts, user_id, event_id) - 1 AS "order", event_id, dt FROM whole_ids
WHERE user_id IN (SELECT user_id FROM day_events WHERE type = 'purchase' AND value >= 100)""",
    "keyword_search": _with(
        CATALOG,
        _found("""SELECT DISTINCT unnest([p_name, p_name || ' ' || p_type, p_brand || ' ' || p_type]) AS keyword FROM part"""),
    )
    + """SELECT keyword, t.type, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score
FROM found, (VALUES ('song'), ('singer')) t(type)""",
    "keyword_search_long": _with(
        CATALOG, _found("SELECT DISTINCT string_agg(DISTINCT p_name, ' ' ORDER BY p_name) AS keyword FROM part GROUP BY p_brand")
    )
    + "SELECT keyword, 'song' AS type, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM found",
    "label_impressions": _with(SEARCH, CATALOG, FIRST_WORDS, _labelled(10))
    + """SELECT type, action, keyword, CAST(position AS INTEGER) AS position, hit AS label, count(*) AS rows,
  CAST(sum(user_id) AS BIGINT) AS users, CAST(sum(candidate) AS BIGINT) AS entities,
  CAST(sum(CASE WHEN type = 'singer' THEN candidate ELSE singer END) AS BIGINT) AS singers,
  CAST(sum(ord) AS BIGINT) AS orders
FROM labelled GROUP BY type, action, keyword, position, hit""",
    "label_impressions_strict": _with(SEARCH, CATALOG, FIRST_WORDS, _labelled(0))
    + """SELECT type, CAST(position AS INTEGER) AS position, hit AS label, count(*) AS rows,
  CAST(sum(CASE WHEN type = 'song' THEN candidate ELSE song END) AS BIGINT) AS songs
FROM labelled GROUP BY type, position, hit""",
    "label_stats": _with(SEARCH, CATALOG, FIRST_WORDS, _labelled(10))
    + """SELECT (SELECT count(*) FROM labelled WHERE hit = 0) AS negatives,
  (SELECT count(*) FROM labelled WHERE hit = 1) AS positives,
  (SELECT count(*) FROM examined WHERE looked AND type IN ('song', 'album', 'playlist', 'singer')) AS examined,
  (SELECT count(*) FROM candidates WHERE type IN ('song', 'album', 'playlist', 'singer')) AS candidates""",
    "search_types": _with(SEARCH) + "SELECT asked, type, count(*) AS events FROM search_events GROUP BY asked, type",
}

# Features ---------------------------------------------------------------------------------


def _stats(key: str, name: str = "stats") -> str:
    return f"""{name} AS (
  SELECT CAST({key} AS BIGINT) AS entity, strftime(l_shipdate, '%Y%m%d') AS dt, count(*) AS play_num,
    count(*) FILTER (WHERE l_returnflag = 'R') AS like_num,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS download_num, CAST(sum(l_linenumber) AS BIGINT) AS share_num,
    count(*) FILTER (WHERE l_linestatus = 'O') AS comment_num
  FROM lineitem GROUP BY ALL)"""


COUNTERS = ["play_num", "like_num", "download_num", "share_num", "comment_num"]
LOGGED = ", ".join(f"round(ln({c} + 1), 6) AS {c}" for c in COUNTERS)
LOGGED_OR_ZERO = ", ".join(f"coalesce(round(ln({c} + 1), 6), 0.0) AS {c}" for c in COUNTERS)
EVENT = """action, keyword, e.type, ts AS "timestamp", e.dt, pos AS position, label, ord AS "order\""""


def _enriched(kind: str, entity: str, names: str, columns: str) -> str:
    return f"""SELECT e.user_id AS "user", e.{kind} AS {entity}, {EVENT}, {columns}, {LOGGED_OR_ZERO}
FROM search_events e LEFT JOIN {names} ON n.k = e.{kind}
LEFT JOIN {kind}_stats s ON s.entity = e.{kind} AND s.dt = e.dt WHERE e.type = '{kind}'"""


FEATURES = {
    "daily_log_stats": _with(_stats("l_partkey")) + f"SELECT entity AS song, dt, {LOGGED} FROM stats",
    "trailing_stats": _with(_stats("l_partkey"))
    + f"SELECT entity AS song, dt, {', '.join(COUNTERS)} FROM stats WHERE dt BETWEEN '19980209' AND '19980215'",
    "enriched_songs": _with(SEARCH, _stats("l_partkey", "song_stats"))
    + _enriched(
        "song",
        "song",
        "(SELECT p_partkey AS k, * FROM part WHERE p_size <= 40) n",
        "coalesce(p_name, '0') AS name, coalesce(p_brand, '0') AS album_name, coalesce(p_type, '0') AS singer_name",
    ),
    "enriched_by_kind": _with(
        SEARCH, _stats("l_suppkey", "singer_stats"), _stats("l_linenumber", "album_stats"), _stats("l_orderkey", "playlist_stats")
    )
    + "\nUNION ALL\n".join(
        _enriched(kind, "entity", f"(SELECT {key} AS k, {name} AS name FROM {table}) n", "coalesce(name, '0') AS name")
        for kind, key, name, table in (
            ("singer", "s_suppkey", "s_name", "supplier"),
            ("album", "n_nationkey", "n_name", "nation"),
            ("playlist", "o_orderkey", "o_orderpriority", "orders"),
        )
    ),
}

FEATURES["search_training"] = (
    _with(
        SEARCH.replace("search_events AS", "all_events AS"),
        """search_events AS (
  SELECT *, row_number() OVER (
      ORDER BY dt DESC, ts, user_id, song, album, playlist, singer, action, keyword, asked) - 1 AS place
  FROM all_events WHERE dt BETWEEN '19980209' AND '19980215'
    AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))""",
        CATALOG,
        _found("SELECT DISTINCT keyword FROM search_events"),
        _labelled(10),
        _stats("l_partkey", "song_stats"),
        _stats("l_suppkey", "singer_stats"),
        _stats("l_linenumber", "album_stats"),
        _stats("l_orderkey", "playlist_stats"),
        """training AS (
  SELECT l.*, coalesce(n.name, '0') AS name FROM labelled l
  LEFT JOIN (
    SELECT 'song' AS kind, p_partkey AS k, p_name AS name FROM part WHERE p_size <= 40
    UNION ALL SELECT 'singer', s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'album', n_nationkey, n_name FROM nation
    UNION ALL SELECT 'playlist', o_orderkey, o_orderpriority FROM orders) n ON n.kind = l.type AND n.k = l.candidate),
figures AS (
  SELECT 'song' AS kind, * FROM song_stats UNION ALL SELECT 'singer', * FROM singer_stats
  UNION ALL SELECT 'album', * FROM album_stats UNION ALL SELECT 'playlist', * FROM playlist_stats)""",
    )
    + f"""SELECT user_id AS "user", candidate AS entity, action, keyword, t.type, ts AS "timestamp", t.dt,
  CAST(position AS INTEGER) AS position, hit AS label, place AS "order", name, {LOGGED_OR_ZERO}
FROM training t LEFT JOIN figures s ON s.kind = t.type AND s.entity = t.candidate AND s.dt = t.dt
  AND s.dt BETWEEN '19980209' AND '19980215'"""
)

# Ranking data -----------------------------------------------------------------------------

SHOWN = """shown AS (
  SELECT CAST(o_custkey AS VARCHAR) AS uid, l_partkey + 1 AS iid, CAST(l_returnflag = 'R' AS INTEGER) AS click,
    l_orderkey AS order_no, l_linenumber AS line_no, l_suppkey AS shop, strftime(l_shipdate, '%Y%m%d') AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

OFTEN = "often AS (SELECT uid, count(*) AS positives FROM shown WHERE click = 1 GROUP BY uid HAVING count(*) > 10)"
ROW_KEY = ("order_no", "line_no", "iid", "shop", "day")
NEGATIVE_LIMIT = round(0.015 * 2**60)
TEST_LIMIT = round(0.1 * 2**60)

RANKING = {
    "pair_batches": _with(
        SHOWN,
        """placed AS (SELECT *, row_number() OVER (ORDER BY order_no, line_no, iid, shop, day, uid, click) - 1 AS spot FROM shown)""",
    )
    + """SELECT CAST(floor(spot / 1024) AS BIGINT) AS batch, count(*) AS rows, min(order_no) AS first_order, CAST(sum(iid) AS BIGINT) AS items
FROM placed GROUP BY ALL""",
    "click_split": _with(SHOWN)
    + """SELECT uid, count(*) FILTER (WHERE click = 1) AS clicked, count(*) FILTER (WHERE click = 0) AS passed FROM shown GROUP BY uid""",
    "frequent_users": _with(SHOWN, OFTEN) + "SELECT uid, positives FROM often",
    "activity_split": _with(SHOWN, OFTEN)
    + """SELECT CASE WHEN uid IN (SELECT uid FROM often) THEN 'often' ELSE 'seldom' END AS activity, uid, count(*) AS rows,
  CAST(sum(click) AS BIGINT) AS clicks FROM shown GROUP BY uid""",
    "label_encode": _with(SHOWN) + "SELECT DISTINCT uid, dense_rank() OVER (ORDER BY uid) - 1 AS label FROM shown",
    "seen_items": _with(SHOWN) + "SELECT DISTINCT uid, iid FROM shown WHERE click = 1",
    "model_sizes": _with(SHOWN) + "SELECT count(DISTINCT uid) AS users, max(iid) AS max_item FROM shown",
    "sample_frac": _with(SHOWN)
    + f"""SELECT uid, iid, click, order_no, line_no, shop, day FROM shown
WHERE click = 0 AND {_bucket(*ROW_KEY)} < {NEGATIVE_LIMIT}""",
    "train_test_split": _with(SHOWN)
    + f"""SELECT CASE WHEN {_bucket(*ROW_KEY)} < {TEST_LIMIT} THEN 'test' ELSE 'train' END AS part, uid, count(*) AS rows,
  CAST(sum(iid) AS BIGINT) AS items FROM shown GROUP BY ALL""",
    "ranking_dataset": _with(
        SHOWN,
        OFTEN,
        f"""parted AS (
  SELECT uid, iid - 1 AS iid, click, CASE
    WHEN click = 1 AND uid IN (SELECT uid FROM often) AND {_bucket(*ROW_KEY)} < {TEST_LIMIT} THEN 'test'
    WHEN click = 1 THEN 'train'
    WHEN uid IN (SELECT uid FROM often) AND {_bucket(*ROW_KEY, seed=8)} < {NEGATIVE_LIMIT} THEN 'test' END AS part
  FROM shown),
labels AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS label FROM (SELECT DISTINCT uid FROM parted WHERE part = 'train'))""",
    )
    + "SELECT label, uid, iid, click, part FROM parted JOIN labels USING (uid) WHERE part IS NOT NULL",
    "negatives": _with(
        SHOWN,
        """positives AS (SELECT *, iid - 1 AS item, row_number() OVER () AS rid FROM shown WHERE click = 1)""",
        "seen AS (SELECT DISTINCT uid, item FROM positives)",
        f"""draws AS (
  SELECT p.*, 0 AS attempt, {_bucket(*ROW_KEY, '0')} % (SELECT max(item) + 1 FROM positives) AS negative FROM positives p
  UNION ALL
  SELECT d.* EXCLUDE (attempt, negative), attempt + 1, {_bucket(*ROW_KEY, 'attempt + 1')} % (SELECT max(item) + 1 FROM positives)
  FROM draws d JOIN seen ON seen.uid = d.uid AND seen.item = d.negative),
firsts AS (SELECT rid, arg_max(negative, attempt) AS negative FROM draws GROUP BY rid)""",
        recursive=True,
    )
    + "SELECT uid, item, negative, order_no, line_no, iid, shop, day FROM positives JOIN firsts USING (rid)",
    "noise_words": _with(
        SENTENCES,
        _vocab(2, ["!", "$"]),
        """marked AS (SELECT list_concat(['$'], tokens, ['!']) AS w FROM sentences),
ahead AS (
  SELECT unnest(w[1:-(gap + 1)]) AS x, unnest(w[gap + 1:]) AS y FROM marked, range(1, 4) g(gap) WHERE len(w) > gap),
pairs AS (
  SELECT DISTINCT unnest([a.id, b.id]) AS center, unnest([b.id, a.id]) AS context
  FROM (SELECT DISTINCT x, y FROM ahead) JOIN vocab a ON a.word = x JOIN vocab b ON b.word = y)""",
        f"""draws AS (
  SELECT DISTINCT center, context, CAST(floor(round(exp(
    (CAST({_bucket('center', 'context', 'CAST(floor(i / 2) AS BIGINT)', start='i % 2 * 15 + 1')} AS DOUBLE) + 0.5::DOUBLE) / 1152921504606846976::DOUBLE * ln((SELECT count(*) FROM vocab) + 1)), 9)) AS BIGINT) AS word
  FROM pairs, range(10) r(i)),
kept AS (SELECT center, count(*) AS words, sum(word) AS id_sum FROM draws WHERE word <> context GROUP BY center),
centers AS (SELECT center, count(*) AS pairs FROM pairs GROUP BY center)""",
    )
    + """SELECT center, pairs, coalesce(words, 0) AS words, CAST(coalesce(id_sum, 0) AS BIGINT) AS id_sum
FROM centers LEFT JOIN kept USING (center)""",
}

# Similarity and evaluation ------------------------------------------------------------------

VECTORS = """vectors AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + label)) AS vec FROM embeddings),
units AS (SELECT id, label, vec, sqrt(list_dot_product(vec, vec)) AS length FROM vectors)"""

SCORED = (
    VECTORS
    + """,
scored AS (
  SELECT l_suppkey AS "user", l_partkey AS item, CAST(l_returnflag = 'R' AS INTEGER) AS click,
    round(1 / (1 + exp(-list_dot_product(a.vec, b.vec))), 6) AS score
  FROM lineitem JOIN vectors a ON a.id = l_suppkey JOIN vectors b ON b.id = l_partkey)"""
)

AUC = """(SELECT round((sum(place) FILTER (WHERE click = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 9)
  FROM (SELECT click, avg(place) OVER (PARTITION BY score) AS place
        FROM (SELECT click, score, CAST(row_number() OVER (ORDER BY score) AS DOUBLE) AS place FROM scored)),
       (SELECT CAST(count(*) FILTER (WHERE click = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE click = 0) AS DOUBLE) AS n0 FROM scored)
  GROUP BY n1, n0)"""
MSE = "(SELECT round(avg((click - score) * (click - score)), 9) FROM scored)"

SIMILARITY = {
    "nearest_vectors": _with(
        VECTORS,
        """asked AS (SELECT min(id) AS id FROM vectors GROUP BY label),
pairs AS (
  SELECT a.id AS query, b.id AS id, list_dot_product(a.vec, b.vec) / (a.length * b.length) AS cosine
  FROM units a JOIN asked USING (id) JOIN units b ON a.id <> b.id)""",
    )
    + """SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, id) AS INTEGER) AS rank, id,
  round(cosine, 6) AS cosine FROM pairs QUALIFY rank <= 8""",
    "recommend_topn": _with(
        VECTORS,
        """pairs AS (SELECT a.id AS "user", b.id AS item, list_dot_product(a.vec, b.vec) AS s FROM vectors a, vectors b)""",
    )
    + """SELECT "user", CAST(row_number() OVER (PARTITION BY "user" ORDER BY round(s, 9) DESC, item) AS INTEGER) AS rank, item,
  round(1 / (1 + exp(-round(s, 9))), 6) AS score FROM pairs QUALIFY rank <= 10""",
    "recommend_unseen": _with(
        VECTORS,
        """seen AS (SELECT DISTINCT l_suppkey AS "user", l_partkey AS item FROM lineitem),
pairs AS (SELECT a.id AS "user", b.id AS item, list_dot_product(a.vec, b.vec) AS s FROM vectors a, vectors b),
fresh AS (SELECT * FROM pairs ANTI JOIN seen USING ("user", item))""",
    )
    + """SELECT "user", CAST(row_number() OVER (PARTITION BY "user" ORDER BY round(s, 9) DESC, item) AS INTEGER) AS rank, item,
  round(1 / (1 + exp(-round(s, 9))), 6) AS score FROM fresh QUALIFY rank <= 10""",
    "score_pairs": _with(SCORED) + 'SELECT "user", item, click, score FROM scored',
    "auc": _with(SCORED) + f"SELECT {AUC} AS auc",
    "mse": _with(SCORED) + f"SELECT {MSE} AS mse",
    "evaluate": _with(SCORED) + f"SELECT {AUC} AS auc, {MSE} AS mse",
}

SIMILARITY["recommend_blocks"] = SIMILARITY["recommend_topn"]

# Next word --------------------------------------------------------------------------------


def _steps(sequences: str, n: int, key: str = "") -> str:
    parts = [
        f"""SELECT {key} {order} AS "order", array_to_string(ids[i - {order}:i - 1], ' ') AS context, ids[i] AS next
  FROM (SELECT {key} ids, unnest(range({order + 1}, len(ids) + 1)) AS i FROM {sequences})"""
        for order in range(1, n)
    ]
    return "(" + "\n  UNION ALL ".join(parts) + ")"


def _ngrams(n: int) -> str:
    return f"""counts AS (
  SELECT "order", context, next, count(*) AS n FROM {_steps('sequences', n)} GROUP BY ALL),
model AS (SELECT *, CAST(sum(n) OVER (PARTITION BY "order", context) AS BIGINT) AS total FROM counts)"""


TOP3 = """both_ends AS (
  SELECT m.*, e.can_end FROM model m, (VALUES (true), (false)) e(can_end)
  WHERE e.can_end OR next <> (SELECT id FROM vocab WHERE word = '!')),
best AS (
  SELECT "order", context, next, n, can_end,
    row_number() OVER (PARTITION BY "order", context, can_end ORDER BY n DESC, next) AS rank
  FROM both_ends QUALIFY rank <= 3)"""

GENERATE = f"""others AS (
  SELECT CAST(context AS BIGINT) AS context, can_end, next, n, rank FROM best WHERE "order" = 1 AND CAST(context AS BIGINT) <> next),
running AS (
  SELECT context, can_end, next, CAST(sum(n) OVER (PARTITION BY context, can_end ORDER BY rank) AS BIGINT) AS upto FROM others),
choices AS (
  SELECT context, can_end, list({{'upto': upto, 'next': next}} ORDER BY upto) AS options, max(upto) AS weight
  FROM running GROUP BY context, can_end),
grown AS (
  SELECT doc_id, line_no, [ids[1]] AS ids, ids[1] AS last, 0 AS step FROM sequences
  UNION ALL
  SELECT doc_id, line_no, CASE WHEN picked IS NULL THEN ids ELSE list_append(ids, picked) END,
    CASE WHEN picked <> (SELECT id FROM vocab WHERE word = '!') THEN picked END, step + 1
  FROM (
    SELECT g.doc_id, g.line_no, g.ids, g.step, list_filter(c.options, lambda o: o.upto > {_bucket('g.doc_id', 'g.line_no', 'g.step')} % c.weight)[1].next AS picked
    FROM grown g LEFT JOIN choices c ON c.context = g.last AND c.can_end = (g.step >= 4)
    WHERE g.last IS NOT NULL AND g.step < 20))"""

SCORES = f"""steps AS {_steps('sequences', 2, 'doc_id, line_no,')},
scores AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, count(*) AS words, round(sum(ln(n / total)), 6) AS log_prob
  FROM steps JOIN model USING ("order", context, next) GROUP BY ALL)"""

CHATS = """chat_lines AS (
  SELECT conv_id, turn, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations))"""

NEXT_WORD = {
    "ngram_model": _with(WHOLE, _ngrams(3))
    + 'SELECT "order", context, next, n, total, round(n / total, 6) AS p FROM model',
    "next_word_top3": _with(WHOLE, _ngrams(3), TOP3)
    + """SELECT "order", context, next, n, can_end, CAST(rank AS INTEGER) AS rank,
  round(n / sum(n) OVER (PARTITION BY "order", context, can_end), 6) AS p FROM best""",
    "generate_sentences": _with(WHOLE, _ngrams(2), TOP3, GENERATE, recursive=True)
    + """SELECT m.doc_id, CAST(m.line_no AS INTEGER) AS line_no, array_to_string(any_value(ids), ' ') AS ids,
  string_agg(word, ' ' ORDER BY pos) AS sentence
FROM (SELECT doc_id, line_no, ids, unnest(ids) AS word_id, unnest(range(len(ids))) AS pos
      FROM (SELECT doc_id, line_no, arg_max(ids, step) AS ids FROM grown GROUP BY doc_id, line_no)) m
JOIN vocab ON vocab.id = m.word_id GROUP BY m.doc_id, m.line_no""",
    "sentence_scores": _with(WHOLE, _ngrams(2), SCORES) + "SELECT doc_id, line_no, words, log_prob FROM scores",
    "cross_entropy": _with(
        WHOLE,
        _ngrams(2),
        CHATS,
        _tokens("chat_sentences", "chat_lines", "conv_id, turn"),
        _whole("chats", "chat_sentences", "conv_id, turn"),
        f"""chat_steps AS {_steps('chats', 2)},
totals AS (SELECT DISTINCT context, total FROM model),
entropy AS (
  SELECT avg(-ln((coalesce(n, 0) + 1) / (coalesce(totals.total, 0) + (SELECT count(*) FROM vocab)))) AS h
  FROM chat_steps s LEFT JOIN model m ON m.context = s.context AND m.next = s.next
  LEFT JOIN totals ON totals.context = s.context)""",
    )
    + "SELECT round(h, 6) AS cross_entropy, round(exp(h), 3) AS perplexity FROM entropy",
}

# Fitted vectors ---------------------------------------------------------------------------


def _start(scale: float) -> str:
    draw = _bucket("id", "place", seed="' || (7 + side) || '")
    return f"(CAST({draw} AS DOUBLE) / 1152921504606846976::DOUBLE * 2 - 1) * {scale!r}"


# The first step of the Adam rule.
ADAM = """moved AS (
  SELECT side, id, place, v - CASE WHEN g IS NULL THEN 0 ELSE 0.01::DOUBLE * sqrt(0.001::DOUBLE) * g / (sqrt(0.001::DOUBLE) * abs(g) + 1e-8) END AS value
  FROM vecs LEFT JOIN (SELECT side, id, place, sum(g) AS g FROM grads GROUP BY ALL) USING (side, id, place))"""

MOVED = """SELECT CAST(side AS INTEGER) AS side, id, CAST(place AS INTEGER) AS place, round(value, 6) AS value, loss, mean_diff FROM moved, figures"""

FITTED = {
    "pairwise_step": _with(
        """triples AS (
  SELECT l_suppkey AS u, l_partkey AS p, 1 + l_orderkey % (SELECT max(p_partkey) FROM part) AS q, CAST(count(*) AS DOUBLE) AS n
  FROM lineitem GROUP BY ALL)""",
        "ids AS (SELECT 0 AS side, u AS id FROM triples UNION SELECT 1, p FROM triples UNION SELECT 1, q FROM triples)",
        f"vecs AS (SELECT side, id, place, {_start((3.0 / 4) ** 0.5)} AS v FROM ids, range(4) r(place))",
        """diffs AS (
  SELECT u, p, q, n, sum(a.v * (b.v - c.v)) AS diff FROM triples
  JOIN vecs a ON a.side = 0 AND a.id = u JOIN vecs b ON b.side = 1 AND b.id = p AND b.place = a.place
  JOIN vecs c ON c.side = 1 AND c.id = q AND c.place = a.place GROUP BY ALL)""",
        "slopes AS (SELECT *, 1 / (1 + exp(-diff)) AS chance, -chance * (1 - chance) * n AS s FROM diffs)",
        """grads AS (
  SELECT 0 AS side, u AS id, b.place, s * (b.v - c.v) AS g FROM slopes
  JOIN vecs b ON b.side = 1 AND b.id = p JOIN vecs c ON c.side = 1 AND c.id = q AND c.place = b.place
  UNION ALL SELECT 1, p, place, s * v FROM slopes JOIN vecs ON side = 0 AND id = u
  UNION ALL SELECT 1, q, place, -s * v FROM slopes JOIN vecs ON side = 0 AND id = u
  UNION ALL SELECT side, id, place, 0.01::DOUBLE * v FROM vecs)""",
        ADAM,
        """figures AS (
  SELECT round(sum(-chance * n) + (SELECT 0.005::DOUBLE * sum(v * v) FROM vecs), 6) AS loss, round(sum(diff * n) / sum(n), 6) AS mean_diff
  FROM slopes)""",
    )
    + MOVED,
    "noise_step": _with(
        "pairs AS (SELECT DISTINCT 1 + l_suppkey AS u, 1 + l_partkey AS c FROM lineitem)",
        "size AS (SELECT CAST(max(p_partkey) + 1 AS DOUBLE) AS parts FROM part)",
        "ids AS (SELECT side, id FROM size, range(2) s(side), range(1, CAST(parts AS BIGINT) + 1) i(id))",
        f"""vecs AS (
  SELECT side, id, place, CASE WHEN side = 0 THEN {_start(1.0)} WHEN place < 4 THEN {_start(0.5)} ELSE 0 END AS v
  FROM ids, range(5) r(place) WHERE side = 1 OR place < 4)""",
        f"""draws AS (
  SELECT i, CAST(floor(round(exp((CAST({_bucket('0', '0', '0', 'i')} AS DOUBLE) + 0.5::DOUBLE) / 1152921504606846976::DOUBLE * ln(parts + 1)), 9)) AS BIGINT) AS id
  FROM size, range(1000) r(i)),
noise AS (SELECT id, min(i) AS i FROM draws GROUP BY id ORDER BY i LIMIT 10)""",
        """asked AS (
  SELECT u, c, -1 AS i, c AS id, -1 AS sign FROM pairs UNION ALL SELECT u, c, i, id, 1 FROM pairs, noise WHERE c <> id),
products AS (
  SELECT u, c, i, asked.id, sign, sum(a.v * b.v) AS product FROM asked
  JOIN vecs a ON a.side = 0 AND a.id = u JOIN vecs b ON b.side = 1 AND b.id = asked.id AND b.place = a.place
  GROUP BY u, c, i, asked.id, sign),
scores AS (
  SELECT p.*, product - ln(1 - pow(1 - ln(1 + 1 / CAST(id AS DOUBLE)) / ln(parts + 1), (SELECT 1 + max(i) FROM noise))) AS score
  FROM products p, size),
slopes AS (
  SELECT *, (1 / (1 + exp(-score)) - CASE WHEN sign < 0 THEN 1 ELSE 0 END) / (SELECT count(*) FROM pairs) AS s,
    sum(sign) OVER (PARTITION BY u, c) + 1 AS noises FROM scores)""",
        """grads AS (
  SELECT 0 AS side, u AS id, place, s * v AS g FROM slopes JOIN vecs w ON w.side = 1 AND w.id = slopes.id AND place < 4
  UNION ALL SELECT 1, slopes.id, place, s * v FROM slopes JOIN vecs w ON w.side = 0 AND w.id = u
  UNION ALL SELECT 1, id, 4, s FROM slopes)""",
        ADAM,
        """figures AS (
  SELECT round(sum(ln(1 + exp(sign * score))) / (SELECT count(*) FROM pairs), 6) AS loss,
    round(sum(CASE WHEN sign < 0 THEN score ELSE -score / noises END) / (SELECT count(*) FROM pairs), 6) AS mean_diff FROM slopes)""",
    )
    + MOVED,
}

# Sources and sinks --------------------------------------------------------------------------

FILES = {
    "delimited_events": _with(SEARCH)
    + """SELECT user_id AS "user", song, album, playlist, singer, action, keyword, asked AS type, ts AS "timestamp", dt,
  pos AS position, label, ord AS "order" FROM search_events""",
    "text_events": _with(SEARCH)
    + """SELECT CAST(user_id AS VARCHAR) AS "user", CAST(song AS VARCHAR) AS song, CAST(album AS VARCHAR) AS album,
  CAST(playlist AS VARCHAR) AS playlist, CAST(singer AS VARCHAR) AS singer, action, keyword, asked AS type,
  ts AS "timestamp", dt, CAST(ord AS VARCHAR) AS "order" FROM search_events""",
    "impression_shards": _with(SHOWN) + "SELECT uid, iid, click FROM shown",
    "id_map": """SELECT c_custkey AS user_id, CAST(floor(abs(c_acctbal) * 2) AS BIGINT) AS number FROM customer
WHERE floor(abs(c_acctbal) * 2) < 10000""",
    "corpus_files": _with(CORPUS) + "SELECT CAST(len(line) AS INTEGER) AS length, count(*) AS lines FROM lines GROUP BY len(line)",
    "saved_vectors": _with(VECTORS)
    + "SELECT id, 'w' || id AS word, CAST(len(vec) AS INTEGER) AS dims, round(list_sum(vec), 6) AS total FROM vectors",
    "ranked_csv": _with(WHOLE, _ngrams(2), SCORES) + "SELECT doc_id, line_no, log_prob AS prob FROM scores",
}

ORACLE: dict[str, str] = {
    **TEXT, **COMMENTS, **SEARCH_LOG, **FEATURES, **RANKING, **SIMILARITY, **NEXT_WORD, **FITTED, **FILES,
}
