import pytest

from corvane.errors import EngineError, InvalidDocument, InvalidFilter, InvalidQuery, InvalidSettings
from corvane.settings import Bm25Settings, ChunkSettings, Filters, GroundingLimits, Query, RetrievalSettings, Settings, Timeouts, bounded, hop_limit

ID = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"


@pytest.mark.parametrize(
    "bad",
    [{"candidate_limit": 501}, {"candidate_limit": 0}, {"final_limit": 101}, {"final_limit": 33}, {"query_max_bytes": 8193}, {"max_document_ids": 101}, {"max_content_types": 101},
     {"vector_weight": 16.000001}, {"bm25_weight": -1.0}, {"graph_weight": float("nan")}, {"rrf_k": 1000001.0}, {"rrf_k": 0.5}, {"vector_weight": 0.0, "bm25_weight": 0.0}],
)
def test_retrieval_ceilings(bad):
    with pytest.raises(InvalidSettings):
        RetrievalSettings(**bad)


def test_filters_count_distinct_values():
    assert Filters.normalise([ID.upper()] * 200, [" Text/Plain "]) == Filters((ID,), ("text/plain",))
    many = [f"{i:08x}-4f89-41d3-9a0c-0305e82c3301" for i in range(101)]
    with pytest.raises(InvalidFilter):
        Filters.normalise(many)
    for bad in ("not-a-uuid", "3f2504e0-4f89-11d3-9a0c-0305e82c3301"):
        with pytest.raises(InvalidFilter):
            Filters.normalise([bad])
    with pytest.raises(InvalidFilter):
        Filters.normalise(content_types=["text/html"])


def test_query_limits_are_bytes():
    assert Query.normalise("  x ").text == "x"
    for bad in ("", " \n\t", "é" * 4097):
        with pytest.raises(InvalidQuery):
            Query.normalise(bad)
    assert bounded("é" * 256, 512, "name")
    with pytest.raises(InvalidQuery):
        bounded("é" * 257, 512, "name")


def test_chunk_settings():
    good = {"chunk_strategy": "fixed_size", "chunk_size": "10", "chunk_overlap": "2"}
    assert ChunkSettings.parse(good) == ChunkSettings("fixed_size", 10, 2)
    for change in ({"chunk_strategy": "odd"}, {"chunk_size": "0"}, {"chunk_size": "x"}, {"chunk_overlap": "10"}, {"chunk_overlap": "-1"}):
        with pytest.raises(InvalidDocument):
            ChunkSettings.parse(good | change)
    with pytest.raises(InvalidDocument):
        ChunkSettings.parse({"chunk_size": "1"})


def test_hops_never_default():
    assert hop_limit(2) == 2
    for bad in (0, 4):
        with pytest.raises(InvalidSettings):
            hop_limit(bad)
    with pytest.raises(InvalidSettings):
        hop_limit(3, configured=2)


def test_other_limits():
    for make in (lambda: Bm25Settings(k1=0), lambda: Bm25Settings(b=1.1), lambda: Bm25Settings(title_boost=-1), lambda: GroundingLimits(16385), lambda: GroundingLimits(8192, 0),
                 lambda: Timeouts(graph=13_000), lambda: Timeouts(generate=59_999)):
        with pytest.raises(EngineError):
            make()
    assert GroundingLimits().total_tokens == 10240


def test_load_from_file_and_environment(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text("allow_model_only = true\n[retrieval]\nfinal_limit = 4\n")
    env = {"CORVANE__RETRIEVAL__CANDIDATE_LIMIT": "20", "CORVANE__BM25__K1": "odd", "CORVANE__CITATION_REPAIR": "false", "OTHER": "1"}
    s = Settings.load(str(path), env)
    assert (s.retrieval.final_limit, s.retrieval.candidate_limit, s.bm25.k1, s.allow_model_only, s.citation_repair) == (4, 20, 1.2, True, False)
    with pytest.raises(InvalidSettings):
        Settings.load(env={"CORVANE__ALLOW_MODEL_ONLY": "maybe"})
