"""Schemas of the engine's tables and JSON documents, as Spark DDL."""

SPAN = "struct<file_path:string,first_character_index:int,last_character_index:int>"
QUESTION = f"struct<question_id:string,question:string,sources:array<{SPAN}>,answer:string>"
DATASET = f"rag_questions array<{QUESTION}>"
RESULT = f"struct<question_id:string,question:string,retrieved_sources:array<{SPAN}>,answer:string>"
RESULTS = f"search_results array<{RESULT}>, k int"
SEARCH_CACHE = f"key string, sources array<{SPAN}>"
ANSWER_CACHE = f"key string, sources array<{SPAN}>, answer string"
