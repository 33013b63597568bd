"""Registered queries against their oracle SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from gneiss.plans import catalog
from gneiss.plans.projections import Tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A sample over all kinds of operators; the driver compares all of them.
NAMES = """g7_impact g7_impact_summary g4_neighbourhood g10_bounded_paths g15_cycles g16_label_propagation g20_data_flow g2_resolve_names g25_graph_query s10_upsert s11_cascade_delete
f1_symbol_search f3_token_search f10_path_risk j6_changed_symbols j7_neighbour_chunks j9_enclosing_symbols j10_dead_code j12_plan_changes j18_shared_members j21_missing_keys a3_dependants
a9_cohesion a12_change_risk a14_merge_findings w1_diversify w6_round_robin w7_ambiguity st3_debounced_bursts c1_chunks p7_generic_symbols p14_diff_lines x11_normal_routes x12_route_map
r1_hybrid_search r13_knn r15_similar_functions r16_fallback_embedding""".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf_dir, oracle, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    cursor = oracle.execute(catalog.ORACLES[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical([tuple(x) for x in got.collect()], got.columns) == canonical(cursor.fetchall(), columns)


def test_every_oracle_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


WHOLE = """g16_label_propagation a9_cohesion p1_python_symbols p7_generic_symbols p7_generic_imports g1_graph_build p13_stack_frames p14_diff_lines c2_semantic_chunks t9_explain_error j9_enclosing_symbols
j16_declarations j18_shared_members r25_source_context f10_path_rules f11_symbol_hints b20_explanations a12_weighted_points a23_slice_validation t3_post_change_review r18_question_intents r19_symbol_terms r19_query_variants
b25_retry r2_graph_candidates g2_resolution b10_ownership b11_referenced_files b32_module_associations b14_code_entry_points b18_graph_contract j23_wrapper_calls b17_handler_rows x15_changed_routes r24_tests_by_calls b28_project_tests r24_found_tests""".split()


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, sf_dir, oracle, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    cursor = oracle.execute(catalog.ORACLES[name])
    columns = [x[0] for x in cursor.description]
    rows = canonical([tuple(x) for x in got.collect()], got.columns)
    assert rows == canonical(cursor.fetchall(), columns) and rows


def test_nation_edges_of_all_parts(spark, sf_dir, oracle):
    sold = {}
    for part, nation in oracle.execute("SELECT l_partkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey").fetchall():
        sold.setdefault(part, set()).add(nation)
    pairs = {(a, b) for nations in sold.values() for a in nations for b in nations if a < b}
    assert {(x.source, x.target) for x in Tables(spark, sf_dir).nation_edges.collect()} == pairs
    assert {str(x) for pair in pairs for x in pair} == {x[0] for x in catalog.QUERIES["g17_communities"](spark, sf_dir).select("node").collect()}
