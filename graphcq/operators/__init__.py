"""Relations over variables: DataFrames whose columns are named after the variables of a query."""
