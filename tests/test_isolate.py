import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmith.operators.isolate import (
    isolate,
    isolation_summary,
    measure_noise,
    noise_group,
    noise_histogram,
)
from corpusmith.profiles import GROUP_BINS, KOREAN, ZERO_GROUP_BINS

TEXTS = [
    "서울 기온 5도",  # clean
    "a#b 경제 $z 성장",  # noisy in hard mode, above the soft range
    "비 오는 날 k팝 x공연 !!",
    "뉴스 속보 어제 오늘 내일 a",  # a little noise
    None,
    "",
    "...",
]


def keys(df):
    return sorted(r[0] for r in df.select("row_key").collect())


def test_hard_isolation_partitions_non_null_rows(corpus):
    noisy, clean = isolate(corpus(TEXTS), "hard", KOREAN)
    assert set(keys(noisy)) | set(keys(clean)) == {f"r{i}" for i in range(7) if i != 4}
    assert not set(keys(noisy)) & set(keys(clean))
    # hard sides carry the raw text
    assert {r.text for r in clean.collect()} >= {"...", ""}


def test_soft_isolation_overlaps_and_leaves_out(corpus):
    # noise shares: 0.105 (both sides), 0.5 (neither), 0 (clean), 0.2 (noisy)
    texts = ["가" * 17 + "##", "가#", "가나다", "가가가가#", "", None]
    noisy, clean = isolate(corpus(texts), "soft", KOREAN)
    assert keys(noisy) == ["r0", "r3"]
    assert keys(clean) == ["r0", "r2"]
    summary = isolation_summary(measure_noise(corpus(texts), "soft"), "soft").head()
    assert summary.asDict() == {
        "n_rows": 6, "n_noisy": 2, "n_clean": 2, "n_both": 1, "n_neither": 3,
        "n_rejected": 2,
    }


def test_unknown_mode(corpus):
    with pytest.raises(ValueError, match="medium"):
        isolate(corpus(TEXTS), "medium")


@pytest.mark.parametrize("bins", [GROUP_BINS, ZERO_GROUP_BINS])
def test_bins_match_pandas_cut(spark, bins):
    uppers = [upper for upper, _ in bins]
    # right-closed, and ratio 0 is in the first bin
    edges = [min(0.0, uppers[0]) - (uppers[0] == 0), *uppers]
    ratios = [i / 40 for i in range(41)] + [0.2, 0.3, 0.8, 1e-9]
    df = spark.createDataFrame([(r,) for r in ratios], "noise_ratio double")
    got = [r[0] for r in df.select(noise_group(F.col("noise_ratio"), bins)).collect()]
    cut = pd.cut(ratios, edges, labels=[name for _, name in bins], include_lowest=True)
    assert got == list(cut)
    counts = noise_histogram(df, bins).orderBy("bin_no").collect()
    assert [(r.noise_group, r.n_rows) for r in counts] == [
        (name, list(cut).count(name)) for _, name in bins
    ]
