import pytest

from corvine.plans import providers
from corvine.plans.providers import ProviderError, build_answerer, build_embedder, build_judge, build_sparse_encoder


def test_factories():
    assert isinstance(build_embedder(), providers.Embedder) and build_embedder("hash", 64).dim == 64
    assert isinstance(build_sparse_encoder(), providers.SparseEncoder) and build_sparse_encoder(stopwords="none").stopwords == ()
    assert isinstance(build_answerer(), providers.Answerer) and isinstance(build_judge(), providers.Judge) and build_judge("none") is None


@pytest.mark.parametrize("build", [build_embedder, build_sparse_encoder, build_answerer, build_judge])
def test_unknown_and_hosted_kinds_are_refused(build):
    for kind in ("fancy", "", "openai"):
        with pytest.raises(ProviderError, match=kind or "unknown"):
            build(kind)
    with pytest.raises(ProviderError, match="members"):
        build("own", own=object())


def test_own_provider(spark):
    class Lengths:
        model, dim = "lengths", 1

        def vector(self, text):
            from pyspark.sql import functions as F

            return F.array(F.length(text).cast("double"))

    own = build_embedder("own", own=Lengths())
    df = spark.createDataFrame([("abc",), ("The of X-1.a",)], "t string")
    assert [r[0] for r in df.select(own.vector(df.t)).collect()] == [[3.0], [12.0]]
    assert [r[0] for r in df.select(build_sparse_encoder().terms(df.t)).collect()] == [["abc"], ["x-1.a"]]
    assert [r[0] for r in df.select(build_sparse_encoder(stopwords="none").terms(df.t)).collect()] == [["abc"], ["the", "of", "x-1.a"]]


def test_bad_settings():
    with pytest.raises(ProviderError, match="dimension"):
        build_embedder("hash", 0)
    with pytest.raises(ProviderError, match="stop words"):
        build_sparse_encoder(stopwords="klingon")
