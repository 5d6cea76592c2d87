"""Table schemas as DDL."""

CHUNKS = "chunk_id string, doc_id string, file string, data_name string, title string, dir_name string, source_type string, chunk_index int, chunk string, size int, created_at timestamp"
EMBED_VECTOR = "chunk_id string, node_id long, chunk string, embedding array<float>"
NODES = "graph_id string, node_id long, text string, emb array<double>"
EDGES = "graph_id string, src long, dst long, weight double, nbr_rank int, method string"
PATHS = "query_id long, src long, dst long, path array<long>, hops int, n_nodes int, weight_prod double, score double, path_text string"
PROMPTS = "query_id long, query string, n_paths int, prompt string"
CHATBOT = "entry_id string, user_id string, query string, llm_response string, retrieval_context string, retrieval_rank int, created_at timestamp"
USER_FILES = "user_id string, filename string, original_filename string, file_path string, file_size_bytes long, file_extension string, graph_path string, num_chunks int, num_ocr_chunks int, num_text_chunks int, embedding_dimension int, processing_ts timestamp"
GRAPH_META = "graph_id string, version long, method string, n_nodes long, n_edges long, edges_added long, avg_degree double, built_at timestamp, reason string"
OCR_RESULT = "text string, confidence double, bbox array<struct<x:int,y:int,w:int,h:int>>, word_boxes array<struct<text:string,confidence:double>>, processing_time double, engine string, error string"

#: The stores that a reset may empty, by their short names.
STORES = {"chunks": CHUNKS, "embed_vector": EMBED_VECTOR, "chatbot": CHATBOT, "user_files": USER_FILES}
