import pytest

from quern.llm import queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, SF, queries.QUERIES[name], queries.ORACLE[name]) is None


COLUMNS = {"p2_found": ["id_a", "id_b"], "p4_found": ["pubkey", "kind", "lev_id"], "p5_found": ["id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0


# all pairs at 0.6, exactly: two sets at the threshold share one of the rarest n - ceil(0.6 n) + 1 words of each
EXACT_PAIRS = r"""WITH e AS MATERIALIZED (SELECT DISTINCT id, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS ws FROM seed_events WHERE kind = 1 AND content IS NOT NULL AND id IS NOT NULL),
    b AS MATERIALIZED (SELECT row_number() OVER () AS r, id, ws, len(ws) AS n FROM e WHERE len(ws) >= 12),
    u AS MATERIALIZED (SELECT r, n, unnest(ws) AS w FROM b), df AS (SELECT w, count(*) AS c FROM u GROUP BY 1),
    o AS (SELECT r, n, u.w, row_number() OVER (PARTITION BY r ORDER BY c, u.w) AS pos FROM u JOIN df ON df.w = u.w),
    p AS MATERIALIZED (SELECT r, n, w FROM o WHERE pos <= n - CAST(ceil(0.6 * n - 1e-9) AS BIGINT) + 1),
    c AS MATERIALIZED (SELECT DISTINCT x.r AS a, y.r AS b FROM p x JOIN p y ON x.w = y.w AND x.r < y.r AND least(x.n, y.n) >= 0.6 * greatest(x.n, y.n) - 1e-9),
    v AS (SELECT x.id AS i, y.id AS j, len(list_intersect(x.ws, y.ws)) AS k, x.n + y.n AS s FROM c JOIN b x ON x.r = c.a JOIN b y ON y.r = c.b)
    SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM v WHERE i <> j AND k >= 0.6 * (s - k) - 1e-9"""


def test_near_duplicates_against_the_exact_join(spark, con):
    """Over the whole stored table: no pair that is none, and no more than one in a hundred missed."""
    want = set(con.execute(EXACT_PAIRS).fetchall())
    got = {tuple(r) for r in queries.p2_found(spark, SF).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 0
