"""Operations of a training-data pipeline over large document tables.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame and column names, returns a DataFrame, and keeps working when an
executor is lost: intermediate results that several later steps read are
written as tables under the folder named by ``spark.checkpoint.dir``.
"""
