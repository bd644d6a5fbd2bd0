"""Analytics over repeated-trial outcome tables, written as Spark DataFrame functions.

A trial is one try at one task: ``(task_id, sample_index, initial_state, final_state)``.
Every public function takes DataFrames and returns a DataFrame.
"""

__version__ = "0.1.0"
