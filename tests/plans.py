"""Text of the physical plan."""


def executed_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
