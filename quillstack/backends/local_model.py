"""A causal language model on the worker's device, by the optional packages transformers and torch."""

from __future__ import annotations

from ..config import SummaryConfig

REPETITION = 1.05


def render(tokenizer, messages: list[dict[str, str]]) -> str:
    """The tokenizer's chat template, with thinking switched off where the template knows of it."""
    given = {"tokenize": False, "add_generation_prompt": True}
    try:
        return tokenizer.apply_chat_template(messages, enable_thinking=False, **given)
    except TypeError:
        return tokenizer.apply_chat_template(messages, **given)


def device_of(devices: tuple[int, ...]) -> int:
    """The GPU that Spark has given the task, else one of ``devices`` by the task's partition."""
    from pyspark import TaskContext

    task = TaskContext.get()
    given = task.resources().get("gpu") if task else None
    if given and given.addresses:
        return int(given.addresses[0])
    return devices[task.partitionId() % len(devices)] if task else devices[0]


def sampling(config: SummaryConfig, max_tokens: int) -> dict:
    """Options of a generation; temperature and top_p count only where it samples."""
    out = {"max_new_tokens": max_tokens, "do_sample": config.sample, "repetition_penalty": REPETITION}
    return out | {"temperature": config.temperature, "top_p": config.top_p} if config.sample else out


class LocalModel:
    """A backend for ``summarise``: loads its model once in a worker process, when the first batch comes."""

    def __init__(self, config: SummaryConfig | None = None):
        self.config, self.loaded = config or SummaryConfig(), None

    def configure(self, config: SummaryConfig) -> None:
        self.config = config

    def load(self):
        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer, BitsAndBytesConfig
        except ImportError as e:
            raise RuntimeError("a local model needs the optional packages torch and transformers") from e
        name = self.config.model
        if not name:
            raise ValueError("no model is named")
        quantised = BitsAndBytesConfig(load_in_4bit=True, bnb_4bit_quant_type="nf4", bnb_4bit_compute_dtype=torch.float16, bnb_4bit_use_double_quant=True) if self.config.four_bit else None
        tokenizer = AutoTokenizer.from_pretrained(name)
        tokenizer.pad_token = tokenizer.pad_token or tokenizer.eos_token
        tokenizer.padding_side = "left"  # so that all answers of a batch start at one place
        model = AutoModelForCausalLM.from_pretrained(name, torch_dtype=torch.float16, quantization_config=quantised, device_map={"": device_of(self.config.devices)})
        return tokenizer, model.eval()

    def generate(self, batch: list[list[dict[str, str]]], max_tokens: int) -> list[str]:
        if self.loaded is None:
            self.loaded = self.load()
        tokenizer, model = self.loaded
        asked = tokenizer([render(tokenizer, m) for m in batch], return_tensors="pt", padding=True).to(model.device)
        ids = model.generate(**asked, pad_token_id=tokenizer.pad_token_id, eos_token_id=tokenizer.eos_token_id, **sampling(self.config, max_tokens))
        return [x.strip() for x in tokenizer.batch_decode(ids[:, asked["input_ids"].shape[1] :], skip_special_tokens=True)]
