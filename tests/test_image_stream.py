"""Images whose descriptors come in several micro-batches."""

from tessella.streaming import images

SCHEMA = "image_id long, desc_no long, vec array<float>, expected long"


def test_histogram_comes_once_when_the_image_is_whole(spark, tmp_path):
    book = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "centre int, centre_vec array<float>")
    arrivals = [
        [(1, 0, [1.0], 3), (2, 0, [9.0], 2), (2, 1, [8.0], 2), (None, 0, [1.0], 1)],
        [(1, 1, [2.0], 3), (3, 0, [1.0], None)],
        [(1, 2, [9.0], 3), (2, 2, [1.0], 2), (3, 1, None, 1), (3, 2, [1.0, 2.0], 1)],
    ]
    seen = []
    for rows in arrivals:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        images.ingest_histograms(stream, book, str(tmp_path / "out"), str(tmp_path / "log"), available_now=True).awaitTermination()
        seen.append(sorted((r.image_id, r.centre, r.tf) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen[0] == seen[1] == [(2, 1, 2)]
    # Image 3 never becomes whole, and what came late for image 2 is left out.
    assert seen[2] == [(1, 0, 2), (1, 1, 1), (2, 1, 2)]
