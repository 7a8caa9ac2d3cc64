"""The registered queries of this subpackage: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hoplens.llm import decontaminate, exact_dedup, jaccard_join, language, line_dedup, merkle, packing, pii, prefix_trie, secret_scan, sharding, spans, suffix_dedup, token_files
from hoplens.llm.common import read_documents
from hoplens.session import scratch_path

SHARDS = 40
CAPACITY = 2048
#: The vocabulary of byte_bpe_50k.json as ranks, which lack its added tokens. With these ids are the same, and encoding takes a
#: fifth of the time.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SPECIAL = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def _sorted_spans(found, only_base=False):
    kept = F.filter(found, lambda s: s["base"]) if only_base else found
    return spans.joined(kept)


def _count(kind):
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(read_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    network = language.train(docs, ~language.held_out())
    return language.identify(docs, network, {"held_out": language.held_out()})


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *(_count(kind) for kind in secret_scan.BASE),
        F.sha2(_sorted_spans(F.col("found"), True), 256).alias("base_sha256"),
        _sorted_spans(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["example"])).cast("long").alias("n_example"),
        F.size(F.filter("found", lambda s: ~s["example"])).cast("long").alias("n_live"),
        F.array_join(F.transform("found", lambda s: s["owners"].cast("string")), ",").alias("owners"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.similar_groups(read_documents(spark, sf_dir))
    return groups.withColumnRenamed("n", "n_shingles")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *(_count(kind) for kind in pii.BASE),
        F.sha2(_sorted_spans(F.col("found"), True), 256).alias("base_sha256"),
        _sorted_spans(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read_documents(spark, sf_dir), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_runs(read_documents(spark, sf_dir)).drop("key")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), CAPACITY, RANKS, public_tokenizers.PATTERN, SPECIAL)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return pairs.withColumnRenamed("item", "item_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.dedupe_table(spark, f"{sf_dir}/documents.parquet")
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_tokens(read_documents(spark, sf_dir), folder, VOCABULARY, END_ID)
    return token_files.read_tokens(spark, folder, with_ids=False)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = merkle.leaf_rows(read_documents(spark, sf_dir), merkle.hit_by_tampering())
    return merkle.prove(merkle.build(leaves))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language": op2_language,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_files": op12_token_files,
    "op13_merkle": op13_merkle,
}

#: Unsigned CRC-32 of a text of ASCII characters, which DuckDB lacks: eight steps for each byte, by the reversed polynomial.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i::BIGINT, 1))::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"""


def _sql_leaf(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    parts = [f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')" for x in fields]
    return f"sha256({' || '.join(parts)})"


SQL = {
    "op9_exact_dedup": """
        WITH rows AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM rows WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (
            SELECT r, i, substr(h, 2 * i + 1, 400) AS s
            FROM d, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS t(i)
        ),
        again AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
        found AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM p WHERE s IN (SELECT s FROM again)),
        islands AS (SELECT r, i, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY r ORDER BY i) AS island FROM found),
        runs AS (SELECT r, min(i) AS first, max(i) + 200 AS last FROM islands GROUP BY r, island),
        gaps AS (SELECT r, first, last, coalesce(lag(last) OVER (PARTITION BY r ORDER BY first), 0) AS kept_from FROM runs),
        cut AS (
            SELECT r, sum(last - first)::BIGINT AS n_removed, count(*) AS n_spans, max(last) AS rest,
                string_agg(substr(h, 2 * kept_from + 1, 2 * (first - kept_from)), '' ORDER BY first) AS kept
            FROM gaps JOIN d USING (r) GROUP BY r
        )
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cut USING (r)
    """,
    "op4_jaccard_join": """
        WITH RECURSIVE worded AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
                lambda w: w <> '') AS w
            FROM documents
        ), shingled AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
            FROM worded
        ), sets AS (
            SELECT s, len(s) AS n, row_number() OVER () AS id FROM (SELECT DISTINCT s FROM shingled WHERE len(s) > 0)
        ), entries AS (
            SELECT id, n, unnest(s) AS e FROM sets
        ), pairs AS (
            SELECT a.id AS a, b.id AS b FROM entries a JOIN entries b ON a.e = b.e AND a.id < b.id
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), links AS (
            SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
        ), reached AS (
            SELECT id, id AS other FROM sets
            UNION
            SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a
        ), holders AS (
            SELECT sets.id, min(doc_id) AS doc_id FROM sets JOIN shingled USING (s) GROUP BY sets.id
        ), components AS (
            SELECT r.id, min(h.doc_id) AS component_id FROM reached r JOIN holders h ON r.other = h.id GROUP BY r.id
        )
        SELECT doc_id, len(shingled.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
        FROM shingled LEFT JOIN sets USING (s) LEFT JOIN components USING (id)
    """,
    "op3_secret_scan": """
        WITH kinds(rank, kind, pattern) AS (VALUES
            (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+'),
            (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'github', 'gh[pousr]_[A-Za-z0-9]{36,}'),
            (4, 'jwt', 'eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}'),
            (5, 'pem', '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----)?')
        ), docs AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS source,
                translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS text
            FROM documents
        ), pieces AS (
            SELECT r, rank, kind, n, piece, strpos(piece, chr(2)) > 0 AS matched
            FROM (
                SELECT r, rank, kind, unnest(p) AS piece, unnest(range(len(p))) AS n
                FROM (
                    SELECT r, rank, kind, string_split(regexp_replace(text, '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p
                    FROM docs, kinds WHERE regexp_matches(text, pattern)
                )
            )
        ), placed AS (
            SELECT r, rank, kind, matched, split_part(piece, chr(2), 1) AS value,
                coalesce(sum(length(piece) - matched::INT) OVER (PARTITION BY r, rank ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    ::BIGINT AS first
            FROM pieces
        ), spans AS (
            SELECT r, rank, kind, first, first + length(value) AS last, CASE kind
                WHEN 'assign' THEN regexp_extract(value, '^[A-Za-z_]+["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)
                WHEN 'pem' THEN regexp_replace(regexp_replace(value, '-----(BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----', '', 'g'), '\\s+', '', 'g')
                ELSE value END AS secret
            FROM placed WHERE matched
        ), kept AS (
            SELECT * FROM spans WHERE CASE kind WHEN 'assign' THEN length(secret) >= 8 WHEN 'access' THEN length(secret) >= 16
                WHEN 'hex' THEN length(secret) >= 32 ELSE true END
        ), held AS (
            SELECT secret, count(DISTINCT source) AS owners FROM kept JOIN docs USING (r) WHERE secret <> '' GROUP BY secret
        ), told AS (
            SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                count(*) FILTER (kind = 'hex') AS n_hex,
                string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank) FILTER (rank < 3) AS base,
                string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank) AS spans,
                count(*) FILTER (coalesce(owners, 1) >= 3) AS n_example, count(*) FILTER (coalesce(owners, 1) < 3) AS n_live,
                string_agg(coalesce(owners, 1)::VARCHAR, ',' ORDER BY first, rank) AS owners
            FROM kept LEFT JOIN held USING (secret) GROUP BY r
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example,
            coalesce(n_live, 0) AS n_live, coalesce(owners, '') AS owners
        FROM docs LEFT JOIN told USING (r)
    """,
    "op5_pii": f"""
        WITH kinds(rank, kind, pattern, score, words) AS (VALUES
            (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', 0.9, 'mail|contact|write'),
            (1, 'ip', '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+', 0.6, 'ip|host|server|address'),
            (2, 'card', '[0-9](?:[\\x20-]?[0-9])+', 0.8, 'card|credit|visa|payment'),
            (3, 'phone', '\\+[0-9][\\x20().0-9-]+[0-9]', 0.6, 'phone|tel|call|mobile|fax'),
            (4, 'iban', '[A-Za-z0-9]+', 0.9, 'iban|account|bank|transfer'),
            (5, 'ssn', '[0-9-]+', 0.3, 'ssn|social security')
        ), docs AS (
            SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS text FROM documents
        ), pieces AS (
            SELECT r, rank, kind, piece, n, strpos(piece, chr(2)) > 0 AS matched
            FROM (
                SELECT r, rank, kind, unnest(p) AS piece, unnest(range(len(p))) AS n
                FROM (
                    SELECT r, rank, kind, string_split(regexp_replace(text, '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p
                    FROM docs, kinds WHERE regexp_matches(text, CASE kind
                        WHEN 'iban' THEN '[A-Z][A-Z][0-9][0-9]' WHEN 'ssn' THEN '[0-9]-[0-9][0-9]-[0-9]' ELSE pattern END)
                )
            )
        ), placed AS (
            SELECT r, rank, kind, matched, split_part(piece, chr(2), 1) AS value,
                coalesce(sum(length(piece) - matched::INT) OVER (PARTITION BY r, rank ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    ::BIGINT AS first
            FROM pieces
        ), proposed AS (
            -- An account number begins at a run of letters and digits, and ends with one.
            SELECT r, rank, kind, first, CASE WHEN kind = 'iban' THEN
                    regexp_extract(substr(text, first + 1, 80), '^(?:{pii.ACCOUNTS})(?:[^A-Za-z0-9]|$)') ELSE value END AS value, text
            FROM placed JOIN docs USING (r)
            WHERE matched AND (kind <> 'iban' OR regexp_matches(value, '^[A-Z][A-Z][0-9][0-9]'))
                AND (kind <> 'ssn' OR regexp_full_match(value, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'))
        ), cut AS (
            SELECT r, rank, kind, first, text, CASE WHEN kind = 'iban' THEN regexp_replace(value, '[^A-Za-z0-9]$', '') ELSE value END AS value
            FROM proposed WHERE value <> ''
        ), checked AS (
            SELECT *, first + length(value) AS last, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
                regexp_replace(value, ' ', '', 'g') AS account
            FROM cut
        ), confirmed AS (
            SELECT *, CASE kind
                WHEN 'ip' THEN regexp_full_match(value, '0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}')
                WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
                    CASE WHEN i % 2 = 1 THEN substr(digits, (length(digits) + 1 - i)::BIGINT, 1)::INT
                        ELSE 2 * substr(digits, (length(digits) + 1 - i)::BIGINT, 1)::INT
                            - 9 * (substr(digits, (length(digits) + 1 - i)::BIGINT, 1)::INT > 4)::INT END)) % 10 = 0
                WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
                WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(substr(account, 5) || substr(account, 1, 4), ''),
                    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END)),
                    lambda rest, x: CASE WHEN x < 10 THEN (rest * 10 + x) % 97 ELSE (rest * 100 + x) % 97 END) = 1
                ELSE true END AS passed
            FROM checked
        ), near AS (
            SELECT *, lead(first) OVER (PARTITION BY r, rank ORDER BY first) AS following, max(CASE WHEN passed OR kind <> 'iban' THEN last END)
                OVER (PARTITION BY r, rank ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
            FROM confirmed
        ), scored AS (
            SELECT n.*, round(least(1.0, score + CASE WHEN regexp_matches(
                right(substr(text, coalesce(previous, 0) + 1, first - coalesce(previous, 0)), 40) || ' ' ||
                left(substr(text, last + 1, greatest(0, coalesce(following, length(text)) - last)), 40),
                '(?i)(?:^|[^a-z])(?:' || words || ')') THEN 0.3 ELSE 0 END)::DOUBLE, 2) AS found
            FROM near n JOIN kinds USING (rank) WHERE passed
        ), told AS (
            SELECT r, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card,
                count(*) FILTER (rank = 3) AS n_phone,
                string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank) FILTER (rank < 4) AS base,
                string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank) AS spans,
                string_agg(found::VARCHAR, ',' ORDER BY first, rank) AS scores
            FROM scored WHERE rank < 4 OR found >= 0.5 GROUP BY r
        )
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
            coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
        FROM docs LEFT JOIN told USING (r)
    """,
    "op7_line_dedup": """
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), lines AS (
            SELECT doc_id, number, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line
            FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS number FROM split)
        ), counted AS (
            SELECT doc_id, number, line, row_number() OVER w AS place,
                len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words
            FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY number)
        ), added AS (
            SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM counted
        ), ends AS (
            SELECT doc_id, place, upto - words AS before, upto FROM added
        ), ahead AS (
            SELECT a.doc_id, a.place AS first, min(b.place) AS last FROM ends a JOIN ends b
            ON a.doc_id = b.doc_id AND b.place >= a.place AND b.upto - a.before >= 50 GROUP BY a.doc_id, a.place
        ), back AS (
            SELECT b.doc_id, max(a.place) AS first, b.place AS last FROM ends a JOIN ends b
            ON a.doc_id = b.doc_id AND b.place >= a.place AND b.upto - a.before >= 50 GROUP BY b.doc_id, b.place
        ), texts AS (
            SELECT doc_id, list(line ORDER BY place) AS l, list(words ORDER BY place) AS w, list(number ORDER BY place) AS numbers
            FROM counted GROUP BY doc_id
        ), runs AS (
            SELECT doc_id, first, last, sha256(array_to_string(list_slice(l, first, last), chr(10))) AS run
            FROM (SELECT * FROM ahead UNION SELECT * FROM back) JOIN texts USING (doc_id)
        ), origins AS (
            SELECT run, min({'doc_id': doc_id, 'first': first}) AS origin FROM runs GROUP BY run HAVING count(*) > 1
        ), later AS (
            SELECT doc_id, first, last, origin.doc_id AS earlier FROM runs JOIN origins USING (run)
            WHERE (doc_id, first) <> (origin.doc_id, origin.first)
        ), reach AS (
            SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last, earlier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM later
        ), islands AS (
            SELECT *, count(*) FILTER (upto IS NULL OR first > upto + 1) OVER (PARTITION BY doc_id ORDER BY first, last, earlier
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM reach
        ), merged AS (
            SELECT doc_id, min(first) AS first, max(last) AS last, first(earlier ORDER BY first, last, earlier) AS earlier_doc_id
            FROM islands GROUP BY doc_id, island
        )
        SELECT doc_id, numbers[first]::INT AS first_line, numbers[last]::INT AS last_line,
            list_sum(list_slice(w, first, last))::INT AS words, earlier_doc_id
        FROM merged JOIN texts USING (doc_id)
    """,
    "op11_prefix_trie": f"""
        WITH own AS (
            SELECT conv_id, list(coalesce(role, '') || chr(0) || coalesce(text, '') ORDER BY turn NULLS FIRST) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), headed AS (
            SELECT *, ({CRC32.format("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM own
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
            FROM headed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
        ), prefixes AS (
            SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS prefix, d = len(turns) AS ended
            FROM rebuilt, unnest(range(0, len(turns) + 1)) AS t(d)
        ), nodes AS (
            SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                CASE WHEN depth = 0 THEN 0
                    ELSE octet_length(encode(substr(prefix[depth], strpos(prefix[depth], chr(0)) + 1))) END AS size,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
            FROM prefixes GROUP BY prefix, depth
        ), under AS (
            SELECT list_slice(parent.prefix, 1, parent.depth - 1) AS prefix, count(*) AS n_children FROM nodes parent WHERE depth > 0 GROUP BY 1
        ), linked AS (
            SELECT n.*, coalesce(u.n_children, 0) AS n_children FROM nodes n LEFT JOIN under u USING (prefix)
        ), sums AS (
            SELECT list_slice(l.prefix, 1, k) AS prefix, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
                sum((n_convs - 1) * size)::BIGINT AS saved_tokens
            FROM linked l, unnest(range(0, depth + 1)) AS t(k) GROUP BY 1
        )
        SELECT l.conv_id, l.depth, p.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens, l.ends_sha256
        FROM linked l JOIN sums s USING (prefix)
        LEFT JOIN nodes p ON p.depth = l.depth - 1 AND p.prefix = list_slice(l.prefix, 1, l.depth - 1)
    """,
    "op13_merkle": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 7 = 0
                THEN {_sql_leaf("(n_chars + 1)")} ELSE {_sql_leaf("n_chars")} END AS claimed,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
            FROM documents
        ), levels AS (
            SELECT lang, 0 AS k, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
            UNION ALL
            SELECT lang, k + 1, list_transform(range(0, (len(nodes) + 1) // 2),
                lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
            FROM levels WHERE len(nodes) > 1
        ), subroots AS (
            SELECT lang, k AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
            FROM levels WHERE len(nodes) = 1
        ), tops AS (
            SELECT 0 AS k, list(subroot ORDER BY tree) AS nodes FROM subroots
            UNION ALL
            SELECT k + 1, list_transform(range(0, (len(nodes) + 1) // 2),
                lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
            FROM tops WHERE len(nodes) > 1
        ), placed AS (
            SELECT l.*, s.height, s.subroot, s.tree FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
        ), siblings AS (
            SELECT p.doc_id, v.k, p.pos >> v.k AS at, v.nodes[xor(p.pos >> v.k, 1) + 1] AS sibling
            FROM placed p JOIN levels v ON p.lang IS NOT DISTINCT FROM v.lang WHERE len(v.nodes) > 1
            UNION ALL
            SELECT p.doc_id, p.height + t.k, p.tree >> t.k, t.nodes[xor(p.tree >> t.k, 1) + 1] FROM placed p, tops t WHERE len(t.nodes) > 1
        ), climb AS (
            SELECT doc_id, 0 AS k, '' AS proof, claimed AS folded FROM placed
            UNION ALL
            SELECT c.doc_id, c.k + 1, c.proof || coalesce(s.sibling, ''), sha256(CASE WHEN s.at & 1 = 0
                THEN c.folded || coalesce(s.sibling, '') ELSE s.sibling || c.folded END)
            FROM climb c JOIN siblings s ON c.doc_id = s.doc_id AND c.k = s.k
        ), ended AS (
            SELECT doc_id, max_by(proof, k) AS proof, max_by(folded, k) AS folded FROM climb GROUP BY doc_id
        ), root AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)
        SELECT p.doc_id, p.leaf, p.subroot, r.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.root AS verified
        FROM placed p JOIN ended e USING (doc_id), root r
    """,
}
