"""How many jobs and tasks the driver of operators has to keep where Spark has many shuffle partitions and leaves them as they are."""

import uuid

import pytest
from tests.llm.cases import documents

from foliant.llm import langid, simhash

MANY = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def counted(spark):
    """A function's result, and the jobs and tasks that it took."""
    sc, before = spark.sparkContext, {k: spark.conf.get(k) for k in MANY}

    def run(f):
        sc.setJobGroup(group := uuid.uuid4().hex, "counted")
        out, tracker = f(), sc.statusTracker()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jobs = [tracker.getJobInfo(x) for x in tracker.getJobIdsForGroup(group)]
        stages = {x for job in jobs for x in job.stageIds}
        return out, len(jobs), sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s)

    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield run
    for k, v in before.items():
        spark.conf.set(k, v)
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_words_of_the_sample_take_few_jobs(spark, counted, tmp_path):
    (tmp_path / "v").write_text("the\nle\nsou\n")
    model, jobs, _ = counted(lambda: langid.train(documents(spark), str(tmp_path / "v")))
    assert model.languages == ["de", "en", "es", "fr"]
    assert 0 < jobs < 40  # one a shuffle partition, and more, before


def test_links_and_rounds_take_few_tasks(spark, counted):
    how = {"radius": simhash.NEAR, "total": simhash.CONFIRMED}
    got, _, tasks = counted(lambda: simhash.near_duplicates(documents(spark), **how).collect())
    assert {r.component_id for r in got if r.doc_id in (1, 6)} == {1}
    assert 0 < tasks < 880
