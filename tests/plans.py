"""What plans move."""

import re


def exchanged_columns(df):
    """The columns that enter any exchange of the plan, broadcasts included."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"^\(\d+\) (?:Broadcast)?Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan, re.M)
    assert inputs
    return {re.sub(r"#\d+L?", "", c.strip()) for line in inputs for c in line.split(",")}
