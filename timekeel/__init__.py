"""timekeel: schedule-adherence analytics as Spark DataFrame operators."""
