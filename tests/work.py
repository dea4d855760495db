"""How much Spark did: rows that went through shuffles."""


def shuffled(spark, action) -> int:
    """Rows that the jobs of ``action`` wrote to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def total() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        jvm, empty = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, empty, jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    action()
    return total() - before
