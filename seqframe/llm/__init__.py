"""Operations on training text: each module is one operator over Spark DataFrames.

Nothing outside this folder imports it. Operators read the columns that they are
given by name and ignore all others, so that extra columns never clash.
"""
