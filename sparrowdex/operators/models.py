"""Adapters for real models. Nothing here is imported, and no model library is needed, until one of them is asked for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Windows(list):
    """A text's token vectors, one array for each window that the model saw."""


def onnx_encoder(folder: str, length: int = 256, stride: int = 32) -> Callable[[], Callable[[list[str]], list[Windows]]]:
    """An encoder for encode.embed() and Engine(encoder=...): a sentence model as folder/model.onnx with folder/tokenizer.json.

    The folder must be on every executor. The model is loaded once per task. A text is read in windows of length tokens that
    overlap by stride, with the tokenizer's own special tokens in each; their vectors are the model's last hidden state.
    """

    def make() -> Callable[[list[str]], list[Windows]]:
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        tokenizer.enable_truncation(length, stride=stride)
        tokenizer.no_padding()
        session = onnxruntime.InferenceSession(f"{folder}/model.onnx")
        wanted = {x.name for x in session.get_inputs()}

        def encode(texts: list[str]) -> list[Windows]:
            parts = [[e, *e.overflowing] for e in tokenizer.encode_batch(texts)]
            every = [w for p in parts for w in p]
            wide = max((len(w.ids) for w in every), default=1) or 1
            feeds = {name: np.zeros((len(every), wide), np.int64) for name in ("input_ids", "attention_mask", "token_type_ids")}
            for k, w in enumerate(every):
                feeds["input_ids"][k, : len(w.ids)] = w.ids
                feeds["attention_mask"][k, : len(w.ids)] = 1
            hidden = session.run(None, {n: v for n, v in feeds.items() if n in wanted})[0] if every else []
            vectors = iter([h[: len(w.ids)] for h, w in zip(hidden, every, strict=True)])
            return [Windows(next(vectors) for _ in p) for p in parts]

        return encode

    make.name = folder.rstrip("/").rsplit("/", 1)[-1]
    return make


def chat_generator(folder: str, max_new_tokens: int = 200) -> Callable[[str, str], str]:
    """A generator for answer.generate() and Engine(generator=...): a chat model in a folder on every executor, by transformers and torch.

    It is loaded when a worker first answers and kept. It runs in half precision on a GPU and in single precision elsewhere, without a
    thinking phase, takes the likeliest token each time, and only new tokens are decoded.
    """
    held: list = []

    def answer(system: str, prompt: str) -> str:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        if not held:
            device = "mps" if torch.backends.mps.is_available() else "cuda" if torch.cuda.is_available() else "cpu"
            tokenizer = AutoTokenizer.from_pretrained(folder)
            if tokenizer.pad_token is None:
                tokenizer.pad_token = tokenizer.eos_token
            model = AutoModelForCausalLM.from_pretrained(folder, torch_dtype=torch.float32 if device == "cpu" else torch.float16).to(device).eval()
            held.extend((tokenizer, model, device))
        tokenizer, model, device = held
        turns = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        text = tokenizer.apply_chat_template(turns, tokenize=False, add_generation_prompt=True, enable_thinking=False)
        asked = tokenizer(text, return_tensors="pt").to(device)
        with torch.no_grad():
            out = model.generate(**asked, max_new_tokens=max_new_tokens, do_sample=False, pad_token_id=tokenizer.pad_token_id)
        return tokenizer.decode(out[0][asked["input_ids"].shape[1] :], skip_special_tokens=True).strip()

    return answer
