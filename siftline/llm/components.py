"""Connected components of a link table, by least labels with pointer jumping."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written, written_at


#: links that one task of a round handles at least
ROWS = 250_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from every node that has a link.

    Each round takes the least label among neighbours and then the label's own label;
    it is one table in the shared folder.  Hubs are handled by partial aggregation
    and by adaptive splitting of skewed joins; nothing is collected but one count.
    """
    pairs = links.where(F.col(a) != F.col(b))
    both = pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        pairs.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct()
    both = written(both)
    tasks = max(1, -(-both.count() // ROWS))  # small link tables do not spread over many small files, round after round
    labels, path = written_at(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")).coalesce(tasks))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        new = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "l").alias("now"))
        to = labels.select(F.col("node").alias("now"), F.col("component").alias("jump"))
        new = new.join(to, "now", "left").select("node", "old", F.least("now", F.coalesce("jump", "now")).alias("component"))
        new, new_path = written_at(new.coalesce(tasks))
        changed = new.where("old <> component").limit(1).count()
        dropped(links.sparkSession, path)  # nothing reads the labels of the round before any more
        labels, path = new.select("node", "component"), new_path
        if not changed:
            return labels
