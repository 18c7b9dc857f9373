"""Jobs on labels, answers and scores; each takes and gives DataFrames."""
