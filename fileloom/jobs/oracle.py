"""SQL for the registered queries, in DuckDB's dialect, written apart from the operators."""

from __future__ import annotations

_CATALOG = r"""
WITH named AS (
  SELECT *, CASE WHEN doc_id % 50 = 0 THEN '.dot-' || doc_id WHEN doc_id % 49 = 0 THEN 'README-' || doc_id
    ELSE lang || '-' || source || '-' || doc_id || '.' ||
         ['txt','md','html','pdf','docx','csv','log','jpeg'][(doc_id % 8)::INT + 1] END AS name
  FROM documents
), files AS (
  SELECT doc_id AS id, name, 'C:\docs\' || lang || '\' || source || '\' || name AS path,
         CASE WHEN doc_id % 97 = 0 THEN 0 ELSE n_chars END AS size,
         TIMESTAMP '2024-01-31' - to_minutes((doc_id * 37)::INT) AS modified, false AS is_dir,
         (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 0 END
          + CASE WHEN doc_id % 13 = 0 THEN 4 ELSE 0 END)::INT AS attributes
  FROM named
), dpaths AS (
  SELECT DISTINCT 'C:\docs\' || lang AS path FROM documents
  UNION SELECT DISTINCT 'C:\docs\' || lang || '\' || source FROM documents
), dirs AS (
  SELECT 10000000 + row_number() OVER (ORDER BY path) AS id, string_split(path, '\')[-1] AS name, path, 0 AS size,
         TIMESTAMP '1970-01-01' AS modified, true AS is_dir, 16 AS attributes
  FROM dpaths
), plain AS (
  SELECT * FROM files UNION ALL SELECT * FROM dirs
), bodies AS (
  SELECT 'C:\docs\' || lang || '\' || source || '\' || name AS path, text AS body FROM named
), cat AS (
  SELECT *, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN lower(string_split(name, '.')[-1]) END AS ext,
         CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END AS stem,
         CASE WHEN contains(name, '.') THEN length(string_split(name, '.')[-1]) ELSE 0 END AS ext_len,
         length(name) AS name_len, len(string_split(path, '\')) - 1 AS depth, lower(path) AS path_norm,
         lower(regexp_extract(path, '^(.*)\\[^\\]+$', 1)) AS parent_norm,
         CASE WHEN is_dir THEN attributes | 16 ELSE attributes END AS eff
  FROM plain
), full_cat AS (
  SELECT cat.*, body FROM cat LEFT JOIN bodies USING (path)
)
"""
_AGE = "((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(modified)) / 1e6)"
_RECENT = f"CASE WHEN {_AGE} >= 0 AND {_AGE} < 604800 THEN 50.0 * (1.0 - {_AGE} / 604800) ELSE 0.0 END"


def _hits(
    where: str = "true",
    atoms: list[tuple[str, str, str]] | None = None,
    terms: list[str] | None = None,
    order: str | None = None,
    limit: int | None = None,
    columns: str = "id, score, name_match, path_match, content_match",
) -> str:
    """where: filters. atoms: SQL for the atom in name, path and body. order: of hits whose score is 0."""
    atoms = [(n, p, f"coalesce({b}, false)") for n, p, b in atoms or []]
    flags = [" AND ".join(f"({a[i]})" for a in atoms) or "false" for i in range(3)]
    match = " AND ".join(f"({n} OR {p} OR {b})" for n, p, b in atoms) or "true"
    names = ", ".join(f"'{t.lower()}'" for t in terms or []) or "''"
    score = (
        "CASE WHEN name_match THEN 1000.0 WHEN path_match THEN 100.0 ELSE 0.0 END"
        " + CASE WHEN content_match THEN 10.0 ELSE 0.0 END"
        f" + CASE WHEN lower(stem) IN ({names}) THEN 200.0 ELSE 0.0 END + {_RECENT}"
    )
    by = order or "raw DESC, name, id"
    rank = f", row_number() OVER (ORDER BY {by})::INT AS rank" if limit is not None else ""
    last = f" WHERE rank <= {limit}" if limit is not None else ""
    return f"""{_CATALOG}, found AS (
  SELECT *, {flags[0]} AS name_match, {flags[1]} AS path_match, {flags[2]} AS content_match
  FROM full_cat WHERE ({where}) AND {match}
), scored AS (
  SELECT *, {"0.0" if order else score} AS raw FROM found
), ranked AS (
  SELECT *, round(raw, 6)::DOUBLE AS score{rank} FROM scored
)
SELECT {columns}{", rank" if limit is not None else ""} FROM ranked{last}"""


def _plain(t: str) -> tuple[str, str, str]:
    return tuple(f"contains(lower({c}), '{t.lower()}')" for c in ("name", "path", "body"))


def _exact(t: str) -> tuple[str, str, str]:
    return tuple(f"contains({c}, '{t}')" for c in ("name", "path", "body"))


def _re(pattern: str) -> tuple[str, str, str]:
    return tuple(f"regexp_matches(lower({c}), '{pattern}')" for c in ("name", "path", "body"))


def _like(pattern: str) -> tuple[str, str, str]:
    return tuple(rf"lower({c}) LIKE '{pattern}' ESCAPE '!'" for c in ("name", "path", "body"))


def _either(*atoms: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple(" OR ".join(f"coalesce({a[i]}, false)" for a in atoms) for i in range(3))


def _name(condition: str) -> tuple[str, str, str]:
    return condition, "false", "false"


def _body(condition: str) -> tuple[str, str, str]:
    return "false", "false", condition


def _without(t: str) -> str:
    n, p, b = _plain(t)
    return f"NOT ({n} OR {p} OR coalesce({b}, false))"


_DAY = "modified >= TIMESTAMP '2024-01-31' - INTERVAL {} DAY"
_W = "[^\\p{L}\\p{N}]"

#: Name: (search, whether it is free text, options), SQL.
_SEARCHES: dict[str, tuple[str, bool, dict, str]] = {
    "F1_ext": ("ext:.PDF;md;", False, {}, _hits("NOT is_dir AND ext IN ('pdf', 'md')")),
    "F1_type": ("type:log", False, {}, _hits("NOT is_dir AND ext = 'log'")),
    "F2_doc": ("doc:x", False, {}, _hits("NOT is_dir AND ext IN ('pdf','doc','docx','txt','md','rtf','odt')")),
    "F2_pic": ("pic:", False, {}, _hits("NOT is_dir AND ext IN ('jpg','jpeg','png','gif','bmp','webp')")),
    "F3_size": ("size:>=1.5kb", False, {}, _hits("size >= 1536")),
    "F3_size_last": ("size:>5kb size:<2kb size:junk", False, {}, _hits("size < 2048")),
    "F4_empty": ("empty:", False, {}, _hits("size = 0")),
    "F5_len": ("len:>15", False, {}, _hits("name_len > 15")),
    "F6_extlen": ("extlen:4", False, {}, _hits("ext_len = 4")),
    "F7_noext": ("noext:", False, {}, _hits("NOT is_dir AND ext IS NULL")),
    "F8_dot": ("dot:", False, {}, _hits("starts_with(name, '.')")),
    "F9_depth": ("depth:<=3", False, {}, _hits("depth <= 3")),
    "F10_today": ("dm:today", False, {}, _hits(_DAY.format(1))),
    "F10_yesterday": (
        "modified:yesterday", False, {},
        _hits(_DAY.format(2) + " AND modified < TIMESTAMP '2024-01-31' - INTERVAL 1 DAY"),
    ),
    "F10_lastweek": ("datemodified:lastweek", False, {}, _hits(_DAY.format(7))),
    "F11_dates": (
        "dm:>2024-01-10 dm:<2024-01-20", False, {},
        _hits("modified >= TIMESTAMP '2024-01-10' AND modified < TIMESTAMP '2024-01-20'"),
    ),
    "F12_file": ("file: path:en", False, {}, _hits("NOT is_dir AND contains(path_norm, 'en')")),
    "F12_folder": ("folder:src1", False, {}, _hits("is_dir", [_plain("src1")], ["src1"])),
    "F13_attrib_all": ("attrib:RH", False, {}, _hits("eff & 3 = 3")),
    "F14_attrib_any": ("attrib:R|S", False, {}, _hits("eff & 5 <> 0")),
    "F15_hidden_system": ("hidden: system:", False, {}, _hits("eff & 6 = 6")),
    "F16_parent": ("parent:C:/DOCS/en/", False, {}, _hits(r"parent_norm = 'c:\docs\en'")),
    "F17_path": ("path:FR/src1", False, {}, _hits(r"contains(path_norm, 'fr\src1')")),
    "F18_root": (r"root:C:\docs\en\src1", False, {}, _hits(r"starts_with(path_norm, 'c:\docs\en\src1')")),
    "T1_term": ("ThinG", False, {}, _hits(atoms=[_plain("thing")], terms=["thing"])),
    "T2_quoted": ('"the and"', False, {}, _hits(atoms=[_plain("the and")], terms=["the and"])),
    "T3_case": ("case: The", False, {}, _hits(atoms=[_exact("The")], terms=["the"])),
    "T4_whole_word": (
        "ww: er", False, {},
        _hits(atoms=[_re(f"(^|{_W})er({_W}|$)")], terms=["er"]),
    ),
    "T5_glob": ("*-src1-*.?d", False, {}, _hits(atoms=[_like("%-src1-%._d")])),
    "T6_regex": ("regex:^en-src1*-.*f$", False, {}, _hits(atoms=[_re("(?s)^en-src1*-.*f$")])),
    "T7_start_end": (
        "startwith:EN- endwith:.PDF", False, {},
        _hits(atoms=[_name("starts_with(lower(name), 'en-')"), _name("ends_with(lower(name), '.pdf')")], terms=["en-", ".pdf"]),
    ),
    "T8_stem": ("stem:src2", False, {}, _hits(atoms=[_name("contains(lower(stem), 'src2')")], terms=["src2"])),
    "T9_body": (
        "content:thing|que", False, {},
        _hits(atoms=[_body("(contains(lower(body), 'thing') OR contains(lower(body), 'que'))")], terms=["thing", "que"]),
    ),
    "T10_name_short": ("n:r", False, {}, _hits(atoms=[_name("contains(lower(name), 'r')")], terms=["r"])),
    "T11_name_narrowed": ("n:read", False, {}, _hits(atoms=[_name("starts_with(lower(name), 'read')")], terms=["read"])),
    "T11_name_anywhere": (
        "n:src1", False, {"narrowing": False}, _hits(atoms=[_name("contains(lower(name), 'src1')")], terms=["src1"]),
    ),
    "T12_and": ("the que", False, {}, _hits(atoms=[_plain("the"), _plain("que")], terms=["the", "que"])),
    "T13_or": ("ándo|pdf", False, {}, _hits(atoms=[_either(_plain("ándo"), _plain("pdf"))], terms=["ándo", "pdf"])),
    "T13_or_spaced": (
        "src1 | src2 | src3", False, {}, _hits(atoms=[_plain("src3")], terms=["src3"]),
    ),
    "T13_or_mixed": (
        "startwith:de-|src4", False, {},
        _hits(
            atoms=[_either(tuple(f"starts_with(lower({c}), 'de-')" for c in ("name", "path", "body")), _plain("src4"))],
            terms=["de-", "src4"],
        ),
    ),
    "T14_not": ("ext:txt !the ! startwith:fr", False, {},
                _hits(f"NOT is_dir AND ext = 'txt' AND {_without('the')} AND NOT starts_with(lower(name), 'fr')")),
    "T14_not_filter_text": ("!ext:pdf ext:pdf", False, {}, _hits("NOT is_dir AND ext = 'pdf' AND " + _without("ext:pdf"))),
    "T15_flags": ("en src1", False, {}, _hits(atoms=[_plain("en"), _plain("src1")], terms=["en", "src1"])),
    "T16_empty_query": ("", False, {}, _hits()),
    "N1_last_week": ("지난 주", True, {}, _hits(_DAY.format(7))),
    "N1_yesterday": (
        "어제", True, {}, _hits(_DAY.format(2) + " AND modified < TIMESTAMP '2024-01-31' - INTERVAL 1 DAY"),
    ),
    "N2_documents": ("문서 이번달", True, {}, _hits("NOT is_dir AND ext IN ('docx','pdf') AND " + _DAY.format(30))),
    "N3_extension": (".PDF md", True, {}, _hits("NOT is_dir AND ext IN ('pdf','md')")),
    "N4_phrase": (
        "지난주 the pdf", True, {},
        _hits("NOT is_dir AND ext = 'pdf' AND " + _DAY.format(7), [_plain("the")], ["the"]),
    ),
    "N4_literal": ("n:x sort:size", True, {}, _hits(atoms=[_plain("n:x"), _plain("sort:size")], terms=["n:x"])),
    "N4_literal_path": (r"c:\docs\en que", True, {}, _hits(atoms=[_plain(r"c:\docs\en"), _plain("que")], terms=[r"c:\docs\en", "que"])),
    "O1_O2_score": ("en|src3 count:40", False, {}, _hits(atoms=[_either(_plain("en"), _plain("src3"))], terms=["en", "src3"], limit=40)),
    "O3_sort_size": ("ext:pdf sort:size count:15", False, {},
                     _hits("NOT is_dir AND ext = 'pdf'", order="size DESC, name, id", limit=15)),
    "O3_sort_date": ("the sort:date count:15", False, {},
                     _hits(atoms=[_plain("the")], order="modified DESC, name, id", limit=15)),
    "O3_sort_name": ("src7 sort:name count:15", False, {}, _hits(atoms=[_plain("src7")], order="name, id", limit=15)),
    "O4_count_none": ("the count:0", False, {}, _hits(atoms=[_plain("the")], terms=["the"], limit=0)),
}

SEARCHES = {k: v[:3] for k, v in _SEARCHES.items()}

_SNIPPET = r"""
, cut AS (
  SELECT *, CASE {first} END AS place, CASE {size} END AS size_at FROM chosen
), sides AS (
  SELECT *, substring(body, 1, (place - 1)::INT) AS bef, substring(body, (place + size_at)::INT) AS aft FROM cut
), text_of AS (
  SELECT *, right(bef, coalesce(list_filter(range(1, 81), lambda k: strlen(right(bef, k::INT)) >= 80)[1], length(bef))::INT)
      || substring(body, place::INT, size_at::INT)
      || left(aft, coalesce(list_filter(range(1, 81), lambda k: strlen(left(aft, k::INT)) >= 80)[1], length(aft))::INT) AS snippet
  FROM sides
)
SELECT id, name, path, rank, score, name_match, path_match, content_match, snippet,
       array_to_string(flatten([{marks}]), ',') AS highlights
FROM text_of
"""


def _with_snippet(hits: str, terms: list[str]) -> str:
    head, _, tail = hits.rpartition("\nSELECT ")
    first = " ".join(f"WHEN contains(lower(body), '{t}') THEN instr(lower(body), '{t}')" for t in terms)
    size = " ".join(f"WHEN contains(lower(body), '{t}') THEN {len(t)}" for t in terms)
    marks = ", ".join(
        f"list_transform(range(1, len(string_split(lower(snippet), '{t}'))), "
        f"lambda i: (list_sum(list_transform(string_split(lower(snippet), '{t}')[1:i], lambda s: strlen(s))) + (i - 1) * {len(t)})::INT"
        f" || '-' || (list_sum(list_transform(string_split(lower(snippet), '{t}')[1:i], lambda s: strlen(s))) + i * {len(t)})::INT)"
        for t in terms
    )
    chosen = f", chosen AS (SELECT {tail})"
    return head + chosen + _SNIPPET.replace("{first}", first).replace("{size}", size).replace("{marks}", marks)


_ALL = "id, name, path, body, score, name_match, path_match, content_match"
_WORDS = "list_distinct(list_filter(list_transform(regexp_split_to_array(body, '[^\\p{L}\\p{N}]+'), lambda x: lower(x)), lambda x: x <> ''))"
_FOLDED = r"""WITH e AS (
        SELECT *, CASE event_type WHEN 'click' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'create' END AS kind,
               user_id || '-' || event_id || '.txt' AS name
        FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'error')
      ), base AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM e WHERE kind <> 'rename')
        WHERE n = 1 AND kind = 'create'
      ), moved AS (
        SELECT user_id, max(event_id) AS event_id, max_by(name, event_id) AS name FROM e WHERE kind = 'rename' GROUP BY user_id
      )
      SELECT b.user_id AS id, CASE WHEN m.event_id > b.event_id THEN m.name ELSE b.name END AS name,
             'C:\u\' || CASE WHEN m.event_id > b.event_id THEN m.name ELSE b.name END AS path, b.ts AS modified
      FROM base b LEFT JOIN moved m USING (user_id)"""
_CHANGED = """, ch AS (
  SELECT doc_id AS seq, path, 'new ' || lang AS body FROM named JOIN files ON files.id = doc_id WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id + 1000000, path, CASE WHEN doc_id % 12 = 0 THEN NULL ELSE 'newer ' || source END
  FROM named JOIN files ON files.id = doc_id WHERE doc_id % 6 = 0
), latest AS (
  SELECT path, body FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS n FROM ch) WHERE n = 1
), now_bodies AS (
  SELECT path, body FROM bodies WHERE path NOT IN (SELECT path FROM latest)
  UNION ALL SELECT path, body FROM latest WHERE body IS NOT NULL
)"""
_MARKUP = (
    "trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace("
    "regexp_replace(regexp_replace(html, '<[^>]*>?', ' ', 'g'), '>', '', 'g'),"
    " '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '),"
    " '&(a|am|amp[^;&][^&;]*|[^a&;][^&;]*|a[^m&;][^&;]*|am[^p&;][^&;]*)?;', '', 'g'), '&amp;', '&'), '[\\s\\p{Z}]+', ' ', 'g'))"
)


def _squeezed(sql: str) -> str:
    """White space of any kind as one space, none at the ends."""
    return rf"trim(regexp_replace({sql}, '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g'))"


ORACLE_SQL: dict[str, str] = {k: v[3] for k, v in _SEARCHES.items()} | {
    "search_flagship": _with_snippet(
        _hits("NOT is_dir AND ext = 'pdf' AND size > 1024", [_plain("the")], ["the"], limit=20, columns=_ALL), ["the"]
    ),
    "X4_X5_snippets": _with_snippet(
        _hits(atoms=[_either(_plain("que"), _plain("der"))], terms=["que", "der"], limit=50, columns=_ALL), ["que", "der"]
    ),
    "D1_D9_derived": _CATALOG + """SELECT id, name, ext, stem, ext_len::INT AS ext_len, name_len::INT AS name_len,
        depth::INT AS depth, path_norm, parent_norm, eff AS eff_attributes FROM cat""",
    "D10_wants_preview": _CATALOG + """SELECT id, coalesce(ext IN ('pdf','docx','xlsx','pptx','png','jpg','jpeg','gif','bmp'), false)
        AS wants_preview FROM cat""",
    "D11_filetime": """SELECT o_orderkey, TIMESTAMP '1970-01-01' + to_microseconds(CASE WHEN o_orderkey % 7 = 0 THEN 0
        ELSE (17000000000000000 + o_orderkey * 1000003) // 10 END) AS modified FROM orders""",
    "S2_skip_directories": """WITH p AS (SELECT doc_id AS id, doc_id % 6 AS k, '/data/target/' ||
        ['.git','node_modules','Node_Modules','target','src','.GIT'][(doc_id % 6)::INT + 1] ||
        CASE WHEN doc_id % 5 = 0 THEN '' ELSE '/' || source END || CASE WHEN doc_id % 10 = 0 THEN '' ELSE '/f.txt' END AS path
        FROM documents) SELECT id, path FROM p WHERE k IN (4, 5) OR id % 10 = 0""",
    "S3_body_gate": _CATALOG + r"""SELECT id, path FROM cat WHERE NOT is_dir AND size <= 20000
        AND ext IN ('txt','md','html','pdf','docx','csv','log')
        AND (starts_with(path, 'C:\docs\en\') OR starts_with(path, 'C:\docs\fr\src1\'))""",
    "S4b_X1_markup_text": f"SELECT page_id, {_MARKUP} AS body FROM pages",
    "S4c_rtf_text": r"""SELECT doc_id, trim(regexp_replace(regexp_replace('{\rtf1\ansi a\\b ' || replace(text, chr(10), '\par ') || '}',
        '\\(?:(\\)|[A-Za-z]* ?)|[{}]', '\1', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS body FROM documents""",
    "S4b_markup_from_pieces": rf"""SELECT doc_id, {_squeezed("lang || ' ' || source || ' ' || text || '  \"'' end'")} AS body FROM documents""",
    "S4c_rtf_from_pieces": rf"""SELECT doc_id, {_squeezed(r"'1' || lang || ' back\slash' || replace(translate(text, '{}\()', ''), chr(10), '')")} AS body FROM documents""",
    "S4d_pdf": rf"""WITH p AS (SELECT doc_id::VARCHAR AS path, regexp_replace(translate(text, '{{}}\()', ''), '[^ -~]', ' ', 'g') AS t FROM documents)
        SELECT path, {_squeezed(r"t || ' a)b %PDF-1.4 BT (' || t || ') Tj (a\)b) Tj ET'")} AS body FROM p""",
    "S4e_office": f"""SELECT doc_id::VARCHAR AS path, ' ' || {_squeezed("text")} AS body FROM documents WHERE text IS NOT NULL""",
    "S1_catalog_of_entries": _CATALOG + r""", n AS (
        SELECT row_number() OVER (ORDER BY path) AS id, name, path, is_dir, regexp_extract(path, '^(.*)\\[^\\]+$', 1) AS up FROM plain)
        SELECT n.id, p.id AS parent_id, n.name, n.path, n.is_dir, CASE WHEN n.is_dir THEN 16 ELSE 0 END::INT AS attributes
        FROM n LEFT JOIN n p ON n.up = p.path""",
    # Row by row, with what is at each path so far (0: nothing) as a list.
    "S7_J3_L3_watcher_feed": r"""WITH RECURSIVE e AS (
        SELECT event_id AS seq, user_id::INT AS a, ((user_id * 7 + event_id) % 150)::INT AS b,
               CASE event_type WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'create' END AS kind,
               row_number() OVER (ORDER BY event_id) AS n,
               CASE WHEN event_type IN ('signup', 'click') THEN row_number() OVER (PARTITION BY event_type IN ('signup', 'click') ORDER BY event_id) END AS new_id
        FROM events WHERE event_type <> 'view'
      ), r AS (
        SELECT 0::BIGINT AS n, list_transform(range(0, greatest((SELECT max(a) FROM e), 150) + 1), lambda x: 0::BIGINT) AS held, 0::BIGINT AS id
        UNION ALL
        SELECT e.n,
               CASE kind WHEN 'create' THEN list_transform(held, lambda x, i: CASE WHEN i = a + 1 THEN new_id ELSE x END)
                         WHEN 'delete' THEN list_transform(held, lambda x, i: CASE WHEN i = a + 1 THEN 0 ELSE x END)
                         ELSE CASE WHEN held[a + 1] = 0 THEN held ELSE list_transform(held, lambda x, i: CASE WHEN i = b + 1 THEN held[a + 1] WHEN i = a + 1 THEN 0 ELSE x END) END END,
               CASE WHEN kind = 'create' THEN new_id ELSE held[a + 1] END
        FROM r JOIN e ON e.n = r.n + 1
      )
      SELECT seq, kind, id, CASE WHEN kind <> 'delete' THEN CASE kind WHEN 'create' THEN a ELSE b END || '.txt' END AS name,
             CASE WHEN kind <> 'delete' THEN 'C:\w\' || CASE kind WHEN 'create' THEN a ELSE b END || '.txt' END AS path
      FROM r JOIN e USING (n) WHERE id > 0""",
    "S7_L3_watched_directories": r"""WITH c AS (
        SELECT *, 'n' || c_nationkey || '\c' || c_custkey AS own, c_custkey % 2 = 0 AS asks_old, c_nationkey % 6 = 0 AS is_moved,
               c_custkey % 5 AS k FROM customer
      ), f AS (
        SELECT 1000 + c_custkey AS seq, ['delete','rename','create','modify','rename'][(k + 1)::INT] AS kind,
               CASE WHEN k = 2 THEN 999999 + row_number() OVER (PARTITION BY k ORDER BY c_custkey) ELSE 1000 + c_custkey END AS id,
               CASE WHEN asks_old THEN 'C:\w\' ELSE 'C:\moved\' END || own || CASE WHEN k = 2 THEN '' ELSE '-new' END AS path, k
        FROM c WHERE k = 2 OR k <> 3 AND asks_old <> is_moved
      )
      SELECT 100 + n_nationkey AS seq, 'rename' AS kind, n_nationkey + 1 AS id, 'n' || n_nationkey AS name, 'C:\moved\n' || n_nationkey AS path
      FROM nation WHERE n_nationkey % 6 = 0
      UNION ALL SELECT seq, kind, id, CASE WHEN k > 0 THEN string_split(path, '\')[-1] END, CASE WHEN k > 0 THEN path END FROM f""",
    "S4a_plain_decode": _CATALOG + "SELECT path, body FROM bodies JOIN files USING (path) WHERE id % 3 <> 2",
    "S5_J5_volume_nodes": r"""WITH n AS (
        SELECT r_regionkey + 100 AS id, 5 AS parent_id, 'C:\' || r_name AS path, true AS is_dir FROM region
        UNION ALL SELECT n_nationkey + 1000, n_regionkey + 100, 'C:\' || r_name || '\' || n_name, true
          FROM nation JOIN region ON r_regionkey = n_regionkey
        UNION ALL SELECT c_custkey + 10000, CASE WHEN c_custkey % 50 = 0 THEN 99 ELSE c_nationkey + 1000 END,
          CASE WHEN c_custkey % 50 = 0 THEN 'C:\' || c_name ELSE 'C:\' || r_name || '\' || n_name || '\' || c_name END, false
          FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
        UNION ALL SELECT 5, NULL, 'C:\', true)
        SELECT id, parent_id, path, 0 AS size, TIMESTAMP '1970-01-01' + to_seconds(id) AS modified, is_dir FROM n""",
    "S6_journal_feed": r"""SELECT event_id AS seq,
        CASE event_type WHEN 'click' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'create' END AS kind, user_id AS id,
        CASE WHEN event_type <> 'error' THEN user_id || '-' || event_id || '.txt' END AS name,
        CASE WHEN event_type <> 'error' THEN 'C:\u\' || user_id || '-' || event_id || '.txt' END AS path,
        CASE WHEN event_type IN ('signup', 'purchase') THEN ts END AS modified,
        CASE WHEN event_type IN ('signup', 'purchase') THEN 0 END AS attributes
        FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'error')""",
    "L4_L5_store": r"""WITH e AS (
        SELECT *, CASE event_type WHEN 'click' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'create' END AS kind,
               user_id || '-' || event_id || '.txt' AS name
        FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'error')
      ), base AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM e WHERE kind <> 'rename')
        WHERE n = 1 AND kind = 'create'
      ), moved AS (
        SELECT user_id, max(event_id) AS event_id, max_by(name, event_id) AS name FROM e WHERE kind = 'rename' GROUP BY user_id
      )
      SELECT b.user_id AS id, CASE WHEN m.event_id > b.event_id THEN m.name ELSE b.name END AS name,
             'C:\u\' || CASE WHEN m.event_id > b.event_id THEN m.name ELSE b.name END AS path, b.ts AS modified,
             length(d.text)::INT AS chars
      FROM base b LEFT JOIN moved m USING (user_id) LEFT JOIN documents d ON d.doc_id = b.user_id""",
    "L2_J4_directory_renames": _CATALOG + r""", shifted AS (
        SELECT id, is_dir, name, string_split(path, '\')[3] AS l, array_to_string(string_split(path, '\')[4:], '\') AS rest FROM plain
      )
      SELECT id, CASE WHEN is_dir AND rest = '' THEN l || CASE WHEN l > 'e' THEN '3' ELSE '2' END ELSE name END AS name,
             CASE WHEN l > 'e' THEN 'C:\moved\' || l || '3' ELSE 'C:\docs\' || l || '2' END
             || CASE WHEN rest = '' THEN '' ELSE '\' || rest END AS path FROM shifted
      UNION ALL SELECT 20000000 + id, name, path FROM files""",
    "L6_move_bodies": _CATALOG + r"""SELECT CASE WHEN lang > 'e' THEN 'C:\moved\' || lang || '3' ELSE 'C:\docs\' || lang || '2' END
        || '\' || source || '\' || name AS path, length(text)::INT AS chars FROM named""",
    "A1_counts": _CATALOG + """SELECT (SELECT count(*) FROM cat) AS files, (SELECT count(*) FROM cat WHERE is_dir) AS directories,
        (SELECT count(*) FROM bodies) AS bodies""",
    "A2_X3_postings": _CATALOG + f"SELECT word, count(*) AS paths FROM (SELECT unnest({_WORDS}) AS word FROM bodies) GROUP BY word",
    "J2_word_lookup": _CATALOG + f"SELECT id, name FROM full_cat WHERE list_contains({_WORDS}, 'the')",
    "J2_all_words": _CATALOG + f"SELECT path FROM bodies WHERE list_has_all({_WORDS}, ['the', 'that', 'onon'])",
    "L1_J6_fold_changes": _FOLDED,
    "L4_file_state": _FOLDED,
    "J2_all_words_in_blocks": _CATALOG + f"SELECT path FROM bodies WHERE list_has_all({_WORDS}, ['the', 'that', 'onon'])",
    "A2_blocks": _CATALOG + f"""SELECT word, n // 256 AS block, min(n) AS first, max(n) AS last, count(*) AS many
        FROM (SELECT n, unnest({_WORDS}) AS word FROM (SELECT body, row_number() OVER (ORDER BY path) - 1 AS n FROM bodies)) GROUP BY ALL""",
    "T18_contains_all": _CATALOG + """SELECT path FROM bodies WHERE contains(lower(body), 'the') AND contains(lower(body), 'thing')
        AND contains(lower(body), 're.')""",
    "T17_names_with_prefix": _CATALOG + "SELECT id, name FROM cat WHERE starts_with(lower(name), 'read')",
    "T19_lookups": _CATALOG + r"SELECT id, path FROM cat WHERE id = 7 OR path = 'C:\docs\en'",
    "A3_next_id": _CATALOG + "SELECT max(id) + 1 AS next_id FROM cat",
    "A4_body_upsert": _CATALOG + _CHANGED + "SELECT path, length(body)::INT AS chars FROM now_bodies",
    "A4_postings_upsert": _CATALOG + _CHANGED
    + f"SELECT word, count(*) AS paths FROM (SELECT unnest({_WORDS}) AS word FROM now_bodies) GROUP BY word",
    "O5_job_limits": f"""WITH h AS ({_hits("name_len <= 7", order="name, id", limit=40, columns="id, path, is_dir")})
        SELECT id, path, rank FROM h WHERE is_dir ORDER BY rank LIMIT 5""",
    "O5_job_limits_files": f"""WITH h AS ({_hits("name_len <= 8", limit=60, columns="id, path, is_dir")})
        SELECT id, path, rank FROM h WHERE NOT is_dir ORDER BY rank LIMIT 7""",
    "K1_json": f"""WITH h AS ({_with_snippet(_hits("NOT is_dir AND ext = 'md'", [_plain("that")], ["that"], limit=10, columns=_ALL.replace("score", "raw AS score")), ["that"])})
        SELECT '{{"path":' || to_json(path) || ',"name":' || to_json(name) || ',"score":' || score_text || ',"name_match":' || name_match
            || ',"path_match":' || path_match || ',"content_match":' || content_match || ',"snippet":' || to_json(snippet)
            || ',"highlights":[' || array_to_string(list_transform(string_split(highlights, ','), lambda x: '[' || replace(x, '-', ',') || ']'), ',')
            || ']}}' AS value FROM (SELECT *, score::VARCHAR AS score_text FROM h)""",
    "K2_paths": _hits("NOT is_dir AND ext = 'csv'", [_plain("thing")], ["thing"], columns="path"),
    "K3_count": f"""SELECT count(*) AS hits FROM ({_hits("NOT is_dir AND ext = 'log'", [_plain("the")], ["the"], limit=100)})""",
}
