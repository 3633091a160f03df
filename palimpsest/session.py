"""Session settings that the operators rely on."""

from pyspark.sql import SparkSession


def get_session(app: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with a pinned time zone and adaptive execution; `conf` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()
